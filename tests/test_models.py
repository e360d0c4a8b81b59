"""Readers of model source trees, on small trees of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from seamline.functions import inflect
from seamline.sources import rails, yii

RUBY = {
    "app/models/application_record.rb": "class ApplicationRecord < ActiveRecord::Base\n  primary_abstract_class\nend\n",
    "app/models/shop.rb": "module Shop\n  def self.table_name_prefix\n    'shop_'\n  end\nend\n",
    "app/models/shop/order.rb": """class Shop::Order < ApplicationRecord
  belongs_to :buyer,
             class_name: "Person"
  has_many :lines, dependent: :destroy  # lines go too
  has_many :remarks, as: :about
  with_options class_name: "Person", optional: true do
    belongs_to :clerk, foreign_key: "handled_by_id"
  end
  after_save :log

  def log
    Audit.create(order: self)
    Shop::Line.where(order_id: id).update_all(seen: true)
  end
end
""",
    "app/models/shop/line.rb": "module Shop\n  class Line < ApplicationRecord\n    belongs_to :order\n  end\nend\n",
    "app/models/person.rb": "class Person < ApplicationRecord\n  include Taggable\n  belongs_to :ghost\nend\n",
    "app/models/concerns/taggable.rb": "module Taggable\n  included do\n    has_many :labels, dependent: :destroy\n  end\nend\n",
    "app/models/label.rb": "class Label < ApplicationRecord\n  self.table_name = 'tags'\nend\n",
    "app/models/remark.rb": "class Remark < ApplicationRecord\n  belongs_to :about, polymorphic: true\nend\n",
    "app/models/staff.rb": "class Staff < Person\nend\n",
    "app/models/audit.rb": "class Audit < ApplicationRecord\n  def all_people = connection.execute('SELECT * FROM people')\nend\n",
    "app/models/helper.rb": "class Helper\nend\n",
    "lib/other.rb": "class Other < ApplicationRecord\nend\n",
}


def _tree(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def _relations(out):
    return {(r.child_table, tuple(r.child_columns), r.parent_table): (r.delete_rule, r.nullable, len(r.evidences)) for r in out["relations"].collect()}


def test_rails(spark, tmp_path):
    out = rails.rails(spark, _tree(tmp_path, RUBY))
    assert _relations(out) == {
        ("shop_orders", ("buyer_id",), "people"): ("NO ACTION", "false", 1),
        ("shop_orders", ("handled_by_id",), "people"): ("NO ACTION", "true", 1),
        ("shop_lines", ("order_id",), "shop_orders"): ("CASCADE", "false", 2),
        ("remarks", ("about_id",), "shop_orders"): ("NO ACTION", "false", 2),
        ("tags", ("person_id",), "people"): ("CASCADE", "unknown", 1),
    }
    assert {r.table for r in out["tables"].collect()} == {"shop_orders", "shop_lines", "people", "tags", "remarks", "audits"}
    suspects = {(r.from_table, r.to_table, r.strong, r.why) for r in out["suspects"].collect()}
    assert suspects == {("shop_orders", "audits", True, "mention"), ("shop_orders", "shop_lines", True, "bulk write"), ("audits", "people", False, "raw read"), ("people", "people", False, "mention")}
    assert [r.note for r in out["notes"].collect()] == ["no model for Person.ghost: not made a relation"]


def test_rails_without_models(spark, tmp_path):
    out = rails.rails(spark, _tree(tmp_path, {"lib/a.rb": "class A\nend\n"}))
    assert all(df.isEmpty() for df in out.values())


PHP = {
    "protected/config/main.php": "<?php return array('db' => array('tablePrefix' => 'app_'));",
    "protected/models/Base.php": "<?php\nabstract class Base extends CActiveRecord\n{\n}\n",
    "protected/models/Shop.php": """<?php
class Shop extends Base
{
    public function tableName() { return '{{shop}}'; } // 'other'
    public function relations()
    {
        return array(
            'owner' => array(self::BELONGS_TO, 'owner', array('owned_by' => 'id')),
            'lines' => array(self::HAS_MANY, Line::class, '', 'on' => "$alias.id = lines.shop_ref"),
            'tags' => array(self::MANY_MANY, 'Tag', '{{shop_tag}}(shop_id, tag_id)'),
            /* 'gone' => array(self::BELONGS_TO, 'Owner', 'gone_id'), */
        );
    }
    public function getLogTable() { return '{{log_' . $this->id . '}}'; }
    public function scopes() { return array('full' => array('with' => array('lines'))); }
    public function beforeDelete()
    {
        Log::model()->deleteAll('shop = ' . $this->id);
        return true;
    }
    public function count() { return Yii::app()->db->createCommand('SELECT 1 FROM {{shop_tag}}'); }
}
""",
    "protected/modules/a/models/Owner.php": "<?php\nclass Owner extends Base\n{\n    public function tableName() { return 'owners'; }\n    public function touch() { Shop::model()->updateAll(array('a' => 1)); }\n}\n",
    "protected/models/Line.php": "<?php\nclass Line extends Shop\n{\n    public function tableName() { return 'line'; }\n    public function relations()\n    {\n        $r = parent::relations();\n        foreach (x() as $f) $r[$f->n] = array(self::BELONGS_TO, $f->t, $f->c);\n        $r['two'] = array(self::BELONGS_TO, 'App\\\\models\\\\Owner', 'a, b');\n        return $r;\n    }\n}\n",
    "protected/models/Log.php": "<?php\nclass Log extends Base\n{\n    /** @var Shop $shop */\n    protected $shop;\n    public function tableName() { return $this->shop->logTable; }\n}\n",
    "protected/models/Plain.php": "<?php\nclass Plain extends CFormModel {}\n",
    "protected/tests/models/Mock.php": "<?php\nclass Mock extends Base { public function tableName() { return 'mock'; } }\n",
}


def test_yii1(spark, tmp_path):
    out = yii.yii1(spark, _tree(tmp_path, PHP))
    assert set(_relations(out)) == {
        ("app_shop", ("owned_by",), "owners"),
        ("line", ("shop_ref",), "app_shop"),
        ("app_shop_tag", ("shop_id",), "app_shop"),
        ("line", ("a", "b"), "owners"),
        ("line", ("owned_by",), "owners"),
        ("line", ("shop_ref",), "line"),
        ("app_shop_tag", ("shop_id",), "line"),
    }
    assert {r.table for r in out["tables"].collect()} == {"app_shop", "owners", "line", "app_log_*", "app_shop_tag"}
    assert {(r.from_table, r.to_table, r.strong, r.why) for r in out["suspects"].collect()} == {
        ("app_shop", "app_log_*", True, "manual cascade"),
        ("app_shop", "app_log_*", True, "mention"),
        ("app_shop", "line", False, "with"),
        ("app_shop", "app_shop_tag", False, "raw read"),
        ("owners", "app_shop", True, "bulk write"),
        ("owners", "app_shop", False, "mention"),
    }
    assert {r.note for r in out["notes"].collect()} == {"no model for Shop.tags: not made a relation", "no model for Line.tags: not made a relation", "Line: 1 relations are made at run time"}


def test_inflection_agrees_with_the_columns(spark):
    words = ["order", "category", "box", "person", "status", "bus", "class", "day", "branch", "datum", "people", "categories", "boxes", "orders", "classes", "analysis"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", inflect.pluralize(F.col("w")).alias("p"), inflect.singularize(F.col("w")).alias("s")).collect()
    assert [(rails.plural(r.w), rails.singular(r.w)) for r in rows] == [(r.p, r.s) for r in rows]


def test_merge_with_a_catalog(spark):
    from seamline.model import RELATION
    from seamline.operators import merge
    from seamline.plans.analysis import Dataset, merge_datasets

    def rel(child, col, parent, source):
        return (f"{child}-{col}", child, [col], None, parent, "NO ACTION", False, "unknown", [(source, "", "", "NO ACTION", "unknown")])

    def data(tables, rels):
        return Dataset(spark.createDataFrame([(t,) for t in tables], "table string"), spark.createDataFrame(rels, RELATION))

    catalog = data(["t_post", "t_user", "t_log_1", "t_log_2", "alone"], [rel("t_post", "user_id", "t_user", "physical"), rel("t_log_1", "post_id", "t_post", "physical")])
    models = data(["post", "user", "log_*"], [rel("post", "user_id", "user", "yii1"), rel("post", "editor_id", "user", "yii1")])
    out = merge_datasets(catalog, models)
    assert {r.table for r in out.tables.collect()} == {"t_post", "t_user", "log_*", "alone"}
    assert {(r.child_table, r.child_columns[0], r.parent_table, tuple(sorted(e.source for e in r.evidences))) for r in out.relations.collect()} == {
        ("t_post", "user_id", "t_user", ("physical", "yii1")), ("log_*", "post_id", "t_post", ("physical",)), ("t_post", "editor_id", "t_user", ("yii1",)),
    }
    listed = spark.createDataFrame([(2, "t_post", ["a", "b"], "USER"), (3, "t_post", ["c"], "nothing")], "line_no int, child string, columns array<string>, parent string")
    new, unknown = merge.metadata_relations(listed, catalog.tables, spark.createDataFrame([("User", "t_user")], "class string, table string"))
    assert [(r.child_table, r.child_columns, r.parent_table) for r in new.collect()] == [("t_post", ["a", "b"], "t_user")]
    assert [r.line_no for r in unknown.collect()] == [3]
