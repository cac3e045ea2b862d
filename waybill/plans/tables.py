"""Shapes of the document tables that several plans share."""

SHIPMENT_TREE = {"items": {"batches": {}}}
ANSWER_TREE = {"header_fields": {}, "test_results": {"sub_items": {"runs": {}}}}
RESULT_FIELDS = "parameter string, specification string, result string"
