"""Questions answered from what is kept."""
