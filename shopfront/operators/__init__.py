"""DataFrame operators: robots, sitemaps, crawl plan, HTTPS, site aggregates, findings."""
