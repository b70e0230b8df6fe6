"""Spark-native text-mining analytics: corpus index, concept and relation expansion, swarm tuning, run store."""
