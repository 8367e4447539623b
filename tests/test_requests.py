import pytest

from webspark.plans import requests as R


def test_pages_of_web_results():
    assert R.web_params("a", "de-de", True, None, 1) == {"q": "a", "kl": "de-de", "kp": "1"}
    assert R.web_params("a", "de-de", None, "w", 3) == {"q": "a", "kl": "de-de", "kp": "-2", "df": "w", "s": "25"}


def test_media_and_meta():
    news = R.media_params("news", "a", "us-en", "4-1", None, "d", 2)
    assert (news["p"], news["s"], news["df"], news["noamp"]) == ("-1", "30", "d", "1")
    images = R.media_params("images", "a", "us-en", "4-1", False, "time:Day", 1)
    assert (images["p"], images["s"], images["f"], images["ct"]) == ("-1", "0", "time:Day", "AT")
    assert R.meta_params("web", "a", "de", True, "day", 2) == {"q": "a", "format": "json", "categories": "general", "pageno": "2", "language": "de", "safesearch": "2", "time_range": "day"}
    assert R.meta_endpoint("https://m.example/") == "https://m.example/search"
    assert R.meta_headers('{"x": "1"}') == ({"content-type": "application/json", "x": "1"}, [])
    assert len(R.meta_headers("[1]")[1]) == 1


def test_ignored_fields():
    assert R.ignored_fields({"prompt": "x", "delay": 1, "scrapeOptions": {"formats": [], "mobile": True}}) == ["delay", "prompt", "scrapeOptions.mobile"]
    assert R.ignored_warning([]) is None


def test_answers_of_models():
    assert [R.is_transient(s) for s in (200, 400, 429, 500, 503)] == [False, False, True, True, True]
    assert R.rejects_schema("Invalid parameter: response_format") and not R.rejects_schema("invalid key")
    assert R.usage({"usage": {"prompt_tokens": 3}}) == {"input": 3} and R.usage({"usage": {}}) is None and R.usage(None) is None
    assert R.answer_content("a") == ("a", None) and R.answer_content({"response": {"b": 1}}) == ('{"b": 1}', {"b": 1})
    with pytest.raises(ValueError):
        R.answer_content({"other": 1})
    assert R.prefixed("workers-ai: x", "workers-ai") == R.prefixed("x", "workers-ai") == "workers-ai: x"
    assert R.chat_body("m", [], {"type": "object"}, True)["response_format"]["json_schema"]["strict"] is True
    assert R.chat_body(None, [], {"type": "object"}, False) == {"messages": [], "temperature": 0, "max_tokens": 2048, "response_format": {"type": "json_object"}}
    assert R.servable("browser", ["images", "news", "web"]) == ["news", "web"]
