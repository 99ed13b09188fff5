"""Part of cohortlens; see README.md."""
