"""Site-audit analytics on Spark: crawl tables in, checks, scores and text analytics out."""
