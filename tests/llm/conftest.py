import pytest


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
