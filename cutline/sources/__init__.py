"""Reading landed files and writing run artefacts."""
