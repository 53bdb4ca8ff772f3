"""packetloom: network-traffic analytics as Spark DataFrame functions."""
