"""Governed, multi-tenant event and knowledge analytics as Spark DataFrame operators."""
