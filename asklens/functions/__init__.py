"""Column expressions and the one batched user-function hook."""
