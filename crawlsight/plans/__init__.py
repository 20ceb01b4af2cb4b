"""Reports: assemblies of checks, scores and text analytics."""
