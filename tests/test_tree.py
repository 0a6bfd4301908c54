from pathlib import Path


def test_test_files_have_names_of_their_own():
    """Two files of one name hide each other where there are no packages."""
    names = [p.name for p in Path(__file__).parent.rglob("test_*.py")]
    assert len(names) == len(set(names))
