from graphloom.llm.chat import rotate, whole_dialogues

ROWS = [
    (1, 0, "system", "Be kind."),
    (1, 1, "ann", "Hi <|im_end|> all"),
    (1, 2, "bob", None),
    (1, 3, "ann", "Bye"),
    (2, 0, "ann", "x"),
    (2, 0, "ann", "x"),
    (3, 5, None, "who"),
    (None, 1, "ann", "lost"),
    (4, None, "ann", "lost"),
    (5, 0, "system", "alone"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, speaker string, ord int")


def test_every_speaker_is_the_assistant_once(spark):
    rotated = rotate(frame(spark, ROWS))
    whole = {(r.conv_id, r.perspective): r for r in whole_dialogues(rotated, 100).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "ann"), (3, "unknown")}
    ann = whole[1, "ann"]
    assert ann.rendering == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <| im_end |> all<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [ann.rendering[s.start : s.end] for s in ann.mask_spans] == ["Hi <| im_end |> all<|im_end|>", "Bye<|im_end|>"]
    assert [whole[1, "bob"].rendering[s.start : s.end] for s in whole[1, "bob"].mask_spans] == ["<|im_end|>"]
    assert len(whole[2, "ann"].mask_spans) == 2


def test_offsets_hold_over_many_blocks(spark):
    rows = [(9, k, "ab"[k % 2], "t" * (k % 7)) for k in range(1500)]
    r = whole_dialogues(rotate(frame(spark, rows)), 10_000).where("perspective = 'a'").first()
    assert len(r.mask_spans) == 750 and all(r.rendering[s.end - 10 : s.end] == "<|im_end|>" for s in r.mask_spans)


def test_empty_table(spark):
    assert rotate(frame(spark, [])).collect() == []
