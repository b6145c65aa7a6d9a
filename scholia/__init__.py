"""Scholia: a learning-analytics and corpus engine written as Spark DataFrame programs."""
