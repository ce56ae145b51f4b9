"""Conversation transcripts to a maintained, queryable knowledge base, as Spark jobs."""
