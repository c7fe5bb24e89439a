"""quizspark: quiz generation and document question answering as DataFrame transformations."""
