"""Spark-native analytics over an archive of public notices, and over any table shaped like one."""
