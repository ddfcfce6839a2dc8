"""Physical building blocks: ordered scans, edges and interval joins that split hot keys."""
