"""The three jobs of an evaluation: ask, combine, analyse."""
