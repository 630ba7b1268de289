"""Tables, the floor dimension, the change feed and the versioned snapshot."""
