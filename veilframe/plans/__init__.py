"""Views over the test tables and end-to-end workflows."""
