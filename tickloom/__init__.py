"""Tick, order-book and research analytics as Spark DataFrame operators."""
