"""Component sources made from the given tables by string templates (Spark only).

The check SQL of the extraction queries does not read these texts: it derives
the expected rows from the same table keys, so it is an independent check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.session import spread
from faultline.sources.tables import bind, table

# braces are doubled: the text passes through a format call
CLASS_SOURCES = """
SELECT org_id, component_id, p_partkey, p_size,
concat('/* header of ', p_name, ' {{ not a brace */
public ', CASE p_size % 3 WHEN 0 THEN 'with sharing ' WHEN 1 THEN 'without sharing ' ELSE '' END, 'class Cls_', CAST(p_partkey AS STRING),
CASE WHEN p_size % 4 = 1 THEN concat(' extends Base_', CAST(p_partkey % 7 AS STRING)) ELSE '' END,
CASE WHEN p_partkey % 6 = 0 THEN ' implements Database.AllowsCallouts, Queueable' WHEN p_partkey % 6 = 1 THEN ' implements Database.Batchable<Id>, Database.Stateful' ELSE '' END, ' {{
    ', CASE WHEN p_partkey % 2 = 0 THEN 'static Map<String, Id> cache = new Map<String, Id>();' ELSE 'Integer plain = 1;' END, '
    public static void run(Integer a, List<Id> ids) {{
        // Helper.skip(); for (
        if (a > 0) {{
            Cls_', CAST(p_partkey % 11 AS STRING), '.check(a);
        }} else if (a < 0 && ids != null) {{
            PKG_CORE.Helper_', CAST(p_partkey % 4 AS STRING), '.other(a);
        }} else {{
            fetch(''none'');
        }}
        for (Integer i = 0; i < a; i++) {{
            ', CASE WHEN p_size % 3 = 0 THEN 'Account acc = [SELECT Id, Name, (SELECT Id FROM Contacts) FROM Account WHERE Id = :a ORDER BY Name DESC LIMIT 5];' ELSE 'Integer j = i;' END, '
            ', CASE WHEN p_size % 2 = 0 THEN 'update accList;' ELSE 'ids.add(null);' END, '
        }}
        rec.Status__c = cache.get(''x'');
        rec.Amount__c = ', CASE p_partkey % 4 WHEN 0 THEN '5' WHEN 1 THEN 'true' WHEN 2 THEN '''txt''' ELSE 'other.Value__c' END, ';
        ', CASE WHEN p_size % 2 = 1 THEN 'update rec;' ELSE 'audit(rec);' END, '
        ', CASE WHEN p_partkey % 8 = 0 THEN 'cache.clear();' ELSE '' END, '
    }}
    @AuraEnabled(cacheable=true)
    public static String fetch(String q) {{
        try {{
            List<Quote> found = Database.query(q);
            Database.insert(found);
        }} catch (DmlException e) {{
            ', CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'System.debug(e);' WHEN 2 THEN 'throw e;' WHEN 3 THEN 'throw new AppException(''x'');' WHEN 4 THEN 'rec.addError(''x'');' WHEN 5 THEN 'EventBus.publish(ev);' ELSE 'count = 1;' END, '
        }}
        ', CASE p_size % 5 WHEN 0 THEN concat('System.enqueueJob(new Job_', CAST(p_partkey % 9 AS STRING), '(q, ''a,b''), 2);') WHEN 1 THEN concat('Queueable job = new Job_', CAST(p_partkey % 9 AS STRING), '();
        System.enqueueJob(job);') WHEN 2 THEN 'Database.executeBatch(this, 50);' WHEN 3 THEN 'System.schedule(''nightly'', ''0 0 1 * * ?'', new Inner_Job());' ELSE 'Integer none = 0;' END, '
        ', CASE WHEN p_partkey % 10 = 0 THEN 'HttpRequest req = new HttpRequest(); req.setEndpoint(''callout:My_Cred/path'');' ELSE '' END, '
        return null;
    }}
    ', CASE WHEN p_partkey % 5 = 0 THEN '@InvocableMethod(label=''x'')
    public static void act(List<Id> recordIds) {{
        Custom__c c = new Custom__c();
    }}' ELSE '' END, '
    class Inner_Job implements Queueable {{
        public void execute(QueueableContext ctx) {{
        }}
    }}
    ', CASE WHEN p_partkey % 12 = 0 THEN 'class AppException extends Exception {{}}' ELSE '' END, '
}}
') AS code FROM {keyed}
"""

TRIGGER_SOURCES = """
SELECT concat('org_', CAST(s_suppkey % 5 AS STRING)) AS org_id, concat('Trg_', CAST(s_suppkey AS STRING)) AS component_id, s_suppkey,
concat('trigger Trg_', CAST(s_suppkey AS STRING), ' on ', CASE WHEN s_suppkey % 2 = 0 THEN 'Account' ELSE 'Order__c' END, ' (before insert', CASE WHEN s_suppkey % 3 = 0 THEN ', after update' ELSE '' END, ') {{
    for (SObject s : Trigger.new) {{
        Cls_', CAST(s_suppkey AS STRING), '.run(1, null);
        ', CASE WHEN s_suppkey % 4 = 0 THEN 'insert s;' ELSE '' END, '
    }}
}}
') AS code FROM {supplier}
"""

CLASS_NAMES = """
SELECT concat('org_', CAST(p_partkey % 5 AS STRING)) AS org_id, concat('Cls_', CAST(p_partkey AS STRING)) AS name FROM {part}
UNION ALL SELECT concat('org_', CAST(s_suppkey % 5 AS STRING)), concat('Job_', CAST(s_suppkey AS STRING)) FROM {supplier}
UNION ALL SELECT concat('org_', CAST(s_suppkey % 5 AS STRING)), concat('Helper_', CAST(s_suppkey AS STRING)) FROM {supplier}
"""

# the files of a bundle as written, in SQL that both engines run
BUNDLE_SOURCES = """
SELECT page_id, concat('lwc/cmp', CAST(page_id AS STRING), '/cmp', CAST(page_id AS STRING), '.js') AS file_path,
  concat('import save from ''@salesforce/apex/Cls_', CAST(page_id AS STRING), '.save'';
import load from "@salesforce/apex/Cls_', CAST(page_id % 7 AS STRING), '.load";
export default class X {{ @wire (getRecord, {{}}) rec; ', CASE WHEN page_id % 2 = 0 THEN '@wire(load) rows;' ELSE '' END, ' }}') AS source FROM {pages}
UNION ALL SELECT page_id, concat('lwc/cmp', CAST(page_id AS STRING), '/cmp', CAST(page_id AS STRING), '.html'),
  concat('<template><c-row></c-row><lightning-card>', html, '</lightning-card></template>') FROM {pages}
UNION ALL SELECT page_id, concat('lwc/cmp', CAST(page_id AS STRING), '/cmp', CAST(page_id AS STRING), '.js-meta.xml'),
  concat('<LightningComponentBundle xmlns="http://x.example.com/md"><isExposed>', CASE WHEN page_id % 4 = 0 THEN ' TRUE ' ELSE 'false' END, '</isExposed><targets><target>lightning__RecordPage</target>',
   CASE WHEN page_id % 5 = 0 THEN '<target>lightning__AppPage</target>' ELSE '' END, '</targets></LightningComponentBundle>') FROM {pages}
"""

BUNDLE_FILES = f"""
SELECT page_id, file_path, CASE WHEN page_id % 3 = 0 THEN base64(CAST(source AS BINARY)) ELSE source END AS source FROM ({BUNDLE_SOURCES}) f
"""


def class_sources(spark: SparkSession, root: str) -> DataFrame:
    keyed = table(spark, root, "part").selectExpr(
        "concat('org_', p_partkey % 5) AS org_id", "concat('Cls_', p_partkey) AS component_id", "p_partkey", "p_size", "p_name"
    )
    return spark.sql(CLASS_SOURCES, keyed=spread(keyed, "org_id", "component_id"))


def trigger_sources(spark: SparkSession, root: str) -> DataFrame:
    return bind(spark, root, TRIGGER_SOURCES)


def class_names(spark: SparkSession, root: str) -> DataFrame:
    return bind(spark, root, CLASS_NAMES).distinct()


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    return bind(spark, root, BUNDLE_FILES)
