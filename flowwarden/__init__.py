"""flowwarden: network-flow intrusion analytics as Spark jobs."""
