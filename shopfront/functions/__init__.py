"""Column functions: URLs, HTML, detectors and contact patterns."""
