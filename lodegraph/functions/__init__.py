"""Column expressions: text, scores, hashed embeddings, redaction."""
