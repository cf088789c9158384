"""Site intelligence as DataFrame -> DataFrame functions over a table of stored web pages."""
