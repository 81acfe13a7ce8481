"""Jobs composed of operators: training, scoring, scenarios, monitoring."""
