"""Chapters are scored in one pass over their text."""

from __future__ import annotations

from gaugeloom import catalog


def test_items_take_comments_out_once_a_chapter(spark, monkeypatch):
    shown, plain = [], catalog.CH.rendered_only
    monkeypatch.setattr(catalog.CH, "rendered_only", lambda text: shown.append(1) or plain(text))
    catalog.chapter_items(spark, "/root/testdata/sf0.001")
    assert len(shown) == 1
