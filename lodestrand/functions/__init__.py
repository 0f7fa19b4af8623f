"""Column expressions and the few Python functions the engine needs."""
