"""quillspark."""
