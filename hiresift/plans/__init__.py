"""Whole plans: screening from text to ranking, recruiter reports, request texts."""
