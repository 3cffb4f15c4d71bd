import pytest

pytest.importorskip("paperloom.llm")
