"""Column functions: text cleaning, paths, outcomes, dialogues, tile grids."""
