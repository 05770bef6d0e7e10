"""DataFrame operators: long lines, tokens, layout, packing, conversations, prompts, metrics, logs."""
