"""Column-level building blocks: text, contact details, skills, sections, similarity."""
