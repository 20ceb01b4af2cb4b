"""Page checks on streams of pages."""
