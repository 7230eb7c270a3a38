"""Sources and sinks: lattices, tensor networks, codes, and the catalogue of saved runs."""
