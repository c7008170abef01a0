"""Knowledge-graph rule mining, link prediction and graph partitioning as Spark plans."""
