"""noteflow.llm: operators that prepare text, pairs, names and vectors for language-model training."""
