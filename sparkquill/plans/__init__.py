"""Whole plans: search sessions, configuration, index builds."""
