"""Games, one module each. A module registers its game when it is imported (`boutline.functions.games.register`); modules of this package and
those that other distributions name under the entry point group ``boutline.games`` are found by themselves."""
