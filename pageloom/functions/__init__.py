"""functions of pageloom."""
