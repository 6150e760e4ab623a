import importlib.util
from pathlib import Path

_spec = importlib.util.spec_from_file_location("tarn_llm_fixtures", Path(__file__).with_name("conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
alnum_words, multiset, ws_words, LOWER = _module.alnum_words, _module.multiset, _module.ws_words, _module.LOWER
