"""Tables, repositories and the index store."""
