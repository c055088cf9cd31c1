"""Plans: orchestration of operators (profile run, cleaning run, preparation,
training) and the registered query catalog."""
