"""Where the public tokenizer files of this installation lie; their path is a parameter."""


def tokenizer_path(name: str) -> str:
    """Return the path of a tokenizer file that is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
