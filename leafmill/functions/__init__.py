"""Part of leafmill; see the README for the map of modules."""
