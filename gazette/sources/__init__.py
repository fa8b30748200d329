"""Configuration dimensions, landing bodies, parse jobs and table sinks."""
