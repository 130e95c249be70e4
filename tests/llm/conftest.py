import pytest

pytest.importorskip("strataq.llm.registry")
