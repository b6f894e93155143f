from lodestone.functions import markdown


def test_runs_without_marks_are_taken_whole():
    """A long text is a few pieces, not one for each character."""
    scan = markdown._Inline("plain words and more, " * 200 + "| a | `b`")
    assert scan.run() == ("plain words and more, " * 200).rstrip() + " a b"
    assert len(scan.out) < 10


def test_blanks_of_labels_stay():
    assert markdown._Inline("x [a ](u)| b \t | c").run() == "x a  b c"
