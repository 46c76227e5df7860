"""plans of pageloom."""
