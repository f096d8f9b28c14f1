"""End-to-end jobs: stored inputs to stored outputs."""
