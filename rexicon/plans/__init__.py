"""From patterns to automata, step tables and choices of plan; all of it small, on the driver."""
