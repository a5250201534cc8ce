"""Tables, derived fixtures and sinks."""
