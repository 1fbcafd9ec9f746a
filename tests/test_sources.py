"""Program files, folders of them, the printer, session blocks, typed answers, streams."""

import pytest

from stratalog.engine import Engine
from stratalog.functions.values import DatalogError
from stratalog.sources.commands import Session
from stratalog.sources.programs import Folder, run_file
from stratalog.sources.text import failure, lines
from stratalog.streaming.feed import feed


def test_files_and_printer(spark, tmp_path):
    path = tmp_path / "one.dl"
    path.write_text("likes(ann, 'two words'). likes(bo, 2.5). likes(X, Y)?")
    e = Engine(spark)
    assert lines(run_file(e, str(path))) == ["X: ann, Y: 'two words'", "X: bo, Y: 2.5"]
    assert lines(e.execute("likes(ann, X), X = none?")) == ["No."] and lines(e.execute("likes(bo, 2.5)?")) == ["Yes."]
    assert lines(e.execute("likes(bo, 2.5)~")) == ["Yes."] and lines(e.execute("likes(bo, 2.5)~")) == ["No."] and lines(None) == []
    with pytest.raises(DatalogError) as error:
        e.execute("p(X).")
    assert failure(error.value)[0].startswith("error: InvalidFact")


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    a, b = tmp_path / "a.dl", tmp_path / "sub" / "b.dl"
    a.write_text("p(1). p(2). q(X) :- p(X).")
    b.write_text("p(2). p(3).")
    e = Engine(spark)
    f = Folder(e, str(tmp_path))
    assert f.sync() == ["a.dl", "sub/b.dl"] and e.answers("q(X)") == [(1,), (2,), (3,)]
    a.write_text("p(1). r(X) :- p(X).")
    assert f.sync() == ["a.dl"] and e.answers("r(X)") == [(1,), (2,), (3,)] and e.answers("q(X)") == []
    b.write_text("p(")
    assert f.sync() == ["sub/b.dl"] and list(f.errors) == ["sub/b.dl"] and e.answers("r(X)") == [(1,)]
    b.unlink()
    assert f.sync() == ["sub/b.dl"] and f.errors == {} and f.sync() == []


def test_session_blocks(spark):
    e = Engine(spark)
    s = Session(e)
    assert s.answer("schema p(N: int, atom). p(2, b). p(1, 'a\tb'). q(X) :- p(X, Y).") == "ok text 0\n"
    assert s.answer("p(X, Y)?") == "ok table 2\nX\tY\n1\ta\\tb\n2\tb\n"
    assert s.answer(".rows p/2 0 1 by 1 desc") == "ok table 1\n1\t2\n2\tb\n"
    assert s.answer(".rows q/1 origin") == "ok table 2\n1\torigin\n1\tderived\n2\tderived\n"
    assert s.answer(".predicates") == "ok text 2\np/2\nq/1\n" and s.answer(".schema p") == "ok text 2\nN: int\n2: atom\n"
    assert s.answer("p(a, b).").startswith("error SchemaViolation") and s.answer(".nothing").startswith("error InvalidSyntax") and s.answer(".rows").startswith("error InvalidSyntax")
    assert s.answer(".watch").startswith("ok text 1\ngeneration ") and s.answer(".quit") == "ok text 0\n" and s.ended


def test_typed_answers(spark):
    e = Engine(spark)
    e.execute("v(ann, 3, 2.5, [1, x]).")
    (r,) = e.results("v(A, B, C, D)")
    assert (r.get_atom("A"), r.get_integer("B"), r.get_float("C"), r.get_value("D")) == ("ann", 3, 2.5, (1, "x"))
    for call, code in ((lambda: r.get_integer("A"), "TypeMismatch"), (lambda: r.get_float("B"), "TypeMismatch"), (lambda: r.get_value("Z"), "UnknownVariable")):
        with pytest.raises(DatalogError) as error:
            call()
        assert error.value.code == code


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 2, False), (2, 3, False), (9, 9, False)], "x long, y long, gone boolean").write.parquet(f"{tmp_path}/in/a")
    e = Engine(spark)
    e.execute("path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), path(Y, Z).")
    stream = spark.readStream.schema("x long, y long, gone boolean").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    run = lambda: feed(stream, e, "edge", f"{tmp_path}/check", deleted="gone", availableNow=True).awaitTermination()
    run()
    assert e.answers("path(1, X)") == [(2,), (3,)]
    spark.createDataFrame([(3, 4, False), (9, 9, True)], "x long, y long, gone boolean").write.parquet(f"{tmp_path}/in/b")
    run()
    assert e.answers("path(1, X)") == [(2,), (3,), (4,)] and e.answers("path(9, X)") == []
