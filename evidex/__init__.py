"""evidex: document analytics and evidence retrieval as plain Spark plans."""
