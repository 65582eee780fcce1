"""Column functions: no I/O, no shuffles, all inside whole-stage code generation."""
