from taxomatch.functions import text, vectors  # noqa: F401
