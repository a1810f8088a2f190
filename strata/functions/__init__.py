"""Column functions: text measures, rules over questions and answers, names."""
