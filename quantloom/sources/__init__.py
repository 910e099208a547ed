"""Tables, sources and sinks."""
