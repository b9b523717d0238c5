"""Training-data operators over documents and pages; nothing outside this folder imports it."""
