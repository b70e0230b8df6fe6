"""Iterative plans: swarm optimisation and the training of expansion weights."""
