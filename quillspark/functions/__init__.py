"""quillspark package."""
