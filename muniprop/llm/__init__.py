"""Training-data operators and the corpus pipeline's parts; nothing else imports this package."""
