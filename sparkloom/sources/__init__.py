"""Tables, and sinks beyond the built-in ones."""
