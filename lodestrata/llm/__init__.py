"""Training-data operators: each module is one operator; nothing outside this folder imports it."""
