"""Flow metadata documents made from ``orders`` by a string template, one document per row (Spark only).

The check SQL derives the expected rows from the same keys without reading the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.session import spread
from faultline.sources.tables import table

DOCUMENT = """
concat('{"processType":"', CASE WHEN o_orderkey % 9 = 0 THEN 'Workflow' ELSE 'AutoLaunchedFlow' END, '","label":"Flow ', o_orderkey, '","runInMode":"SystemMode",
"start":{"object":"Obj', o_custkey % 4, '__c","triggerType":"', CASE WHEN o_custkey % 2 = 0 THEN 'RecordAfterSave' ELSE 'RecordBeforeSave' END, '","recordTriggerType":"Update","connector":{"targetReference":"Check"}',
 CASE WHEN o_orderkey % 2 = 0 THEN ',"filters":[{"field":"Status__c","operator":"EqualTo","value":{"stringValue":"x","numberValue":null}}]' ELSE '' END,
 CASE o_orderkey % 3 WHEN 0 THEN ',"doesRequireRecordChangedToMeetCriteria":true' WHEN 1 THEN ',"doesRequireRecordChangedToMeetCriteria":false' ELSE '' END,
 CASE WHEN o_orderkey % 8 = 0 THEN ',"scheduledPaths":[{"name":"Later","offsetNumber":2,"offsetUnit":"Days","timeSource":"RecordField"}]' ELSE '' END, '},
"decisions":[{"name":"Check","label":"Check it","rules":[{"name":"R1","conditionLogic":"and","conditions":[{"leftValueReference":"$Record.A__c","operator":"EqualTo","rightValue":{"booleanValue":true}}],"connector":{"targetReference":"Upd"}}],"defaultConnector":{"targetReference":"Look"}}],
"recordUpdates":[{"name":"Upd","label":"Update","inputReference":"$Record","inputAssignments":[{"field":"Status__c","value":{"stringValue":"', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'done' END, '"}}],"connector":{"targetReference":"Act"}',
 CASE WHEN o_orderkey % 3 = 0 THEN ',"faultConnector":{"targetReference":"Look"}' ELSE '' END, '}],
"recordLookups":[{"name":"Look","label":"Find","object":"Account","filters":[{"field":"Name","operator":"EqualTo","value":{"elementReference":"$Record.Name"}}],"getFirstRecordOnly":true,"outputReference":"acc","connector":{"targetReference":"Loop1"}}],
"loops":[{"name":"Loop1","label":"Each","collectionReference":"items","iterationOrder":"Asc","nextValueConnector":{"targetReference":"Asg"},"noMoreValuesConnector":{"targetReference":"Act"}}],
"assignments":[{"name":"Asg","label":"Set","assignmentItems":[{"assignToReference":"$Record.Amount__c","operator":"Assign","value":{"elementReference":"$User.Id"}},{"assignToReference":"acc.Pkg__Name__c","operator":"Assign","value":{"formulaExpression":"1+1","formulaDataType":"Number"}},{"assignToReference":"loose.Other__c","operator":"Assign","value":{"weird":"?"}},{"assignToReference":"plain","operator":"Add","value":{"numberValue":5}}]',
 CASE WHEN o_orderkey % 4 = 0 THEN ',"connector":{"targetReference":"Loop1"}' ELSE '' END, '}],',
 CASE WHEN o_orderkey % 6 = 0 THEN '"recordCreates":[{"name":"Cre","label":"Make","object":"Log__c","inputReference":"acc"}],' ELSE '' END,
 CASE WHEN o_orderkey % 7 = 0 THEN '"screens":[{"name":"Lost","label":"Lost"}],' ELSE '' END, '
"actionCalls":[{"name":"Act","label":"Run","actionType":"', CASE WHEN o_custkey % 3 = 0 THEN 'emailAlert' ELSE 'apex' END, '","actionName":"Cls_', o_custkey, '","inputParameters":[{"name":"id","value":{"elementReference":"$Record.Id"}}],"outputParameters":[{"name":"out"}]',
 CASE WHEN o_orderkey % 5 = 0 THEN ',"connector":{"targetReference":"Sub"}' ELSE '' END, '}],
"subflows":[{"name":"Sub","label":"More","flowName":"Flow_', o_custkey, '"}]}')
"""


def flow_documents(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").selectExpr(
        "o_orderkey", "o_custkey", "concat('org_', o_orderkey % 5) AS org_id", "concat('Flow_', o_orderkey) AS flow_id"
    )
    return spread(orders, "org_id", "flow_id").selectExpr(
        "org_id", "flow_id", f"{DOCUMENT} AS metadata",
        "CASE WHEN o_orderkey % 10 = 3 THEN 'Draft' ELSE 'Active' END AS status", "o_custkey % 60 AS version_number",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'Pkg' END AS namespace",
    )


def field_update_documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").selectExpr(
        "CASE WHEN c_custkey % 5 = 0 THEN concat('Update', c_custkey) ELSE concat('Obj', c_custkey % 4, '__c.Update', c_custkey) END AS full_name",
        """concat('{"targetObject":"Obj', c_custkey % 4, '__c"', CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(',"field":"', CASE WHEN c_custkey % 3 = 0 THEN 'Parent__r.' ELSE '' END, 'Field_', c_custkey % 10, '__c"') END,
        ',"operation":"', CASE WHEN c_custkey % 2 = 0 THEN 'Formula' ELSE 'Null' END, '"', CASE WHEN c_custkey % 4 = 0 THEN ',"formula":"NOW()"' WHEN c_custkey % 4 = 1 THEN ',"literalValue":"L"' ELSE '' END, '}') AS metadata""",
    )
