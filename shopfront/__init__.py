"""Web-presence analytics on Spark: business leads, crawl snapshots and site audits."""
