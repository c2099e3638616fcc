"""The registered queries of the verbs, each with its SQL."""
