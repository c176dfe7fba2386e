import pytest

pytest.importorskip("textrel.llm")
