"""Extensions that run on streams."""
