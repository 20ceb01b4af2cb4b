"""Crawl tables, site context and catalogs in; result tables out."""
