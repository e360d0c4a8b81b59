"""The work of the readers of source trees grows with the files, not with their square."""

from __future__ import annotations

import sys

from seamline.sources import rails, yii
from seamline.sources.models import Found, Source


def _lines(read, sources) -> tuple[int, Found]:
    """How many lines of Python, turns of loops among them, read runs for the sources; and what it finds."""
    n = 0

    def each(frame, event, arg):
        nonlocal n
        n += event == "line"
        return each

    old = sys.gettrace()
    sys.settrace(each)
    try:
        found = read(sources)
    finally:
        sys.settrace(old)
    return n, found


def _grows(read, tree) -> None:
    read(tree(10))  # patterns are compiled
    (small, _), (large, _) = (_lines(read, tree(n)) for n in (200, 800))
    assert large < 4.8 * small


def _rails(n: int) -> list[Source]:
    out = [Source("app/models/nation.rb", "class Nation < ApplicationRecord\n" + "".join(f"  has_many :vendor{k}s\n" for k in range(n)) + "end")]
    for k in range(n):
        out.append(Source(f"app/models/vendor{k}.rb", f"class Vendor{k} < ApplicationRecord\n  belongs_to :nation\n  def a = Nation.touch_all\n  def b = Vendor{(k + 1) % n}.update_all(a: 1)\nend", [f"vendor{(k + 2) % n}s"], ["nations", "absent"]))
    return out


def test_rails_work_grows_with_the_models():
    _grows(rails.read, _rails)


def test_rails_child_of_many_owners():
    """A class that belongs to many, each of which has many of it, is read once."""
    def tree(n):
        child = Source("app/models/line.rb", "class Line < ApplicationRecord\n" + "".join(f"  belongs_to :owner{k}\n" for k in range(n)) + "end")
        return [child] + [Source(f"app/models/owner{k}.rb", f"class Owner{k} < ApplicationRecord\n  has_many :lines\nend") for k in range(n)]

    _grows(rails.read, tree)


def test_rails_suspects_of_a_tree():
    """Raw SQL counts for the first model of a file alone, and for tables of models."""
    two = Source("app/models/two.rb", "class One < ApplicationRecord\nend\nclass Two < ApplicationRecord\nend", ["threes", "ones", "absent"], ["twos"])
    rows = rails.read([Source("app/models/three.rb", "class Three < ApplicationRecord\nend"), two]).rows
    assert [(r["a"], r["b"], r["strong"], r["label"]) for r in rows if r["kind"] == "suspect"] == [("ones", "threes", True, "raw write"), ("ones", "twos", False, "raw read")]


def _yii(n: int) -> list[Source]:
    """A class that has many of each of the others, which name each other and tables of other letter case in raw SQL."""
    rows = ",\n".join(f"'v{k}' => [self::HAS_MANY, 'Vendor{k}', 'nation_id']" for k in range(n))
    out = [Source("protected/config/main.php", "<?php return array('tablePrefix' => 't_');")]
    out += [Source("protected/models/Nation.php", "<?php class Nation extends CActiveRecord {\n function relations() { return [" + rows + "]; } }")]
    for k in range(n):
        text = f"<?php class Vendor{k} extends CActiveRecord {{ function tableName() {{ return '{{{{Vendor{k}}}}}'; }} function a() {{ Vendor{(k + 1) % n}::model()->updateAll(); }} }}"
        out.append(Source(f"protected/models/Vendor{k}.php", text, [f"vendor{(k + 2) % n}"], ["nation", "absent"]))
    return out


def test_yii_work_grows_with_the_classes():
    _grows(yii.read, _yii)


def test_yii_relations_of_a_tree():
    """Lines are those of the relations; a table that is known by relations alone is found by raw SQL, of names that the prefix tells apart the one as written."""
    rows = yii.read(_yii(3)).rows
    assert [(r["a"], r["b"], r["origin"].rpartition(":")[2]) for r in rows if r["kind"] == "relation"] == [(f"t_Vendor{k}", "Nation", str(2 + k)) for k in range(3)]
    many = "<?php class Tag extends CActiveRecord { function relations() { return [\n'a' => [self::MANY_MANY, 'Tag', 'Tag_Link(x, y)'],\n'b' => [self::MANY_MANY, 'Tag', 't_tag_link(x, y)']]; } }"
    config = Source("protected/config/main.php", "<?php return array('tablePrefix' => 't_');")
    rows = yii.read([config, Source("protected/models/Tag.php", many, ["tag_link"], ["t_tag_link"])]).rows
    assert [(r["a"], r["b"], r["strong"], r["label"]) for r in rows if r["kind"] == "suspect"] == [("Tag", "Tag_Link", True, "raw write"), ("Tag", "t_tag_link", False, "raw read")]


def test_yii_suspects_of_a_tree():
    rows = yii.read(_yii(4)).rows
    of = lambda k: {(r["b"], r["strong"], r["label"]) for r in rows if r["kind"] == "suspect" and r["a"] == f"t_Vendor{k}"}
    assert [of(k) for k in range(4)] == [{(f"t_Vendor{(k + 1) % 4}", True, "bulk write"), (f"t_Vendor{(k + 1) % 4}", False, "mention"), (f"t_Vendor{(k + 2) % 4}", True, "raw write"), ("Nation", False, "raw read")} for k in range(4)]
