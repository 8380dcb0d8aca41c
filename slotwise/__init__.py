"""Switchback (time-slot) experiment analytics as Spark DataFrame operators."""
