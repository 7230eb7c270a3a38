"""Whole queries: what the engine answers, each with the SQL that stands for it where SQL can."""
