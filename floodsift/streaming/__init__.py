"""The window volume and the filter on live streams."""
