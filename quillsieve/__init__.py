"""Spark-native analytics over tool and command output."""
