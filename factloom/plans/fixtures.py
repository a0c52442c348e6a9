"""Small tables in the shapes that the engine reads, as rows; for Spark and, as VALUES, for any SQL."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from . import given

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "printed": ("id int, raw string", [(i, r) for i, r in enumerate(["1,234.50", "(2,824.59)", "(-5)", "nil", "-", "–", "Rs 4,85,92,00,000", "₹ 37,685.70", "Not disclosed", "12 34", "abc", "", "−17", "- 3", "0.5", "7*", "^8.25", "(9)", "1,00,000 crore", None])]),
    "facts": ("company string, scope string, key string, found boolean, value string, value_prior string, ord int", [
        ("acme", "standalone", "Share Premium", True, "1,000", "900", 1), ("acme", "standalone", "Hedging Reserve", True, "(50)", "(40)", 2), ("acme", "consolidated", "Share Premium", True, "100.0", "950", 3),
        ("acme", "consolidated", "Other CWIP", False, None, None, 4), ("bolt", "standalone", "Share Premium", True, "12.5", "-", 5), ("bolt", "standalone", "Other CWIP", True, "77", "76.5", 6),
        ("bolt", "standalone", "Equity Issued", False, None, None, 7), ("bolt", "consolidated", "Hedging Reserve", True, "nil", "3", 8), ("acme", "standalone", "Share Premium", True, "1,005", "905", 9),
    ]),
    "truth": ("company string, scope string, key string, expected string, status string", [
        ("acme", "standalone", "Share Premium", "1,004", "ok"), ("acme", "standalone", "Hedging Reserve", "(52)", "ok"), ("acme", "consolidated", "Share Premium", "1000", "ok"), ("acme", "consolidated", "Other CWIP", "Not disclosed", "ok"),
        ("bolt", "standalone", "Share Premium", "-", "ok"), ("bolt", "standalone", "Other CWIP", "77.3", "ok"), ("bolt", "standalone", "Equity Issued", "45", "ok"), ("bolt", "consolidated", "Hedging Reserve", "-", "ok"), ("bolt", "consolidated", "Equity Issued", "5", "ok"),
    ]),
    "prior": ("company string, scope string, key string, value string", [("acme", "standalone", "Share Premium", "905"), ("acme", "standalone", "Hedging Reserve", "(45)"), ("acme", "consolidated", "Share Premium", "949"), ("bolt", "standalone", "Other CWIP", "76.5")]),
    "verified": ("company string, scope string, key string, value string, ord int", [("acme", "standalone", "Share Premium", "1,006", 1), ("acme", "standalone", "Share Premium", "1,007", 2), ("acme", "standalone", "Other CWIP", "3", 3), ("acme", "consolidated", "Equity Issued", None, 4), ("none", "standalone", "Share Premium", "9", 5)]),
    "parent_lines": ("label string, value string, note_ref string", [("Trade payables", "5.0", "12"), ("Trade payables", "5.0", "12"), ("Profit before trade payables", "99", "3"), ("Other trade payables and borrowings", "(2)", None), ("Borrowings", "-", "14"), ("Retained earnings", "7", None), (None, "4", None)]),
    "gap_tokens": ("doc string, page int, token string", [("a", p, t) for p, ts in ((1, ["1,234", "(5,678)", "9,012.5", "12", "9,012.5;"]), (2, ["1,234", "7,777", "8,888"]), (3, ["7,777", "8,888", "1,111.0", "7,777"]), (4, ["2,222", "3,333", "4,444"]), (5, ["2,222", "3,333", "4,444"]), (6, ["2,222", "3,333", "4,444"]), (7, ["2,222", "3,333", "4,444"])) for t in ts] + [("b", 1, "10,00,000"), ("b", 1, "5.000"), ("b", 1, "6.0001"), ("b", 1, "abcd")]),
    "gap_cells": ("doc string, cell string", [("a", "x 1,234"), ("a", "5678"), ("a", None), ("b", "77")]),
    "more_tables": ("doc string, page int, n int, grid array<array<string>>", [("a", 2, 1, [["x", "7,777"], ["y", "8,888 1,234"], ["z", "7777"]]), ("a", 2, 2, [["x", "1,234"], ["y", "5,678"], ["z", "9,999"]]), ("b", 1, 1, [["", "1111"], [None, "2222"], ["3333", ""]])]),
    "scan_pages": ("doc string, page int", [("a", 2), ("a", 2), ("c", 1)]),
    "image_pages": ("doc string, page int, text string, has_image boolean", [("a", 1, None, True), ("a", 2, " ", True), ("a", 3, "x", True), ("a", 4, "", False), ("b", 1, "", True)]),
    "shown_aliases": ("section string, aliases array<string>", [("ppe", ["a", "b", "c", "d"]), ("deferred_tax", ["a", "b", "c", "d"]), ("ppe", ["a"])]),
    "asset_keys": ("key string", [("gross_block_office_equipment",), ("accumulated_depreciation_of_Vehicles",), ("gross_block_land",), ("net_block_land",), ("gross_block_aircraft",), ("Gross_Furniture",)]),
    "absent_values": ("doc string, key string, value string", [("a", "x", None), ("a", "y", "5"), ("b", "x", None), ("b", "z", None)]),
    "rescued_values": ("doc string, key string, value string, grounded boolean", [("a", "x", "9", True), ("a", "x", "8", True), ("a", "y", "7", True), ("b", "x", "6", False), ("b", "z", None, True)]),
    "registry_items": ("key string, scope string, value_type string, concept string, column_hint string, location_hint string, aliases array<string>", [
        ("Share Premium", "both", None, " Premium over face value ", None, "Other equity note", [" Securities premium", "", "Share premium "]), ("Interest Expense", "standalone", "monetary", None, "current year", None, None), ("Sundry Creditors", "both", "count", "x", "y ", "trade payables note", ["a"]),
    ]),
    "registry_kpis": ("format string, label string, key string, q string, also array<string>", [("bank", "Banks", "nim", "What is the margin?", ["net interest margin", "spread"]), ("bank", "Banks", "npa", "What is bad?", []), ("insurer", None, "ratio", "Which ratio?", ["cover"])]),
    "asked_items": ("doc string, key string, section string", [("a", "k1", "ppe"), ("a", "k2", "ppe"), ("a", "k3", "share_capital"), ("a", "k4", "share_capital"), ("a", "k5", "investments"), ("a", "k6", "pl_changes_inventory"), ("a", "k6", "pl_changes_inventory"), ("b", "k1", "ppe"), ("b", "k3", None), ("b", "k6", "pl_changes_inventory")]),
    "section_readings": ("doc string, key string, priority int, value string, confidence string", [
        ("a", "k1", 2, "10", "grounded"), ("a", "k2", 3, "20", "reconciled"), ("a", "k3", 2, None, "absent"), ("a", "k3", 1, None, "absent"), ("a", "k4", 1, "7", "unverified"), ("a", "k4", 1, "6", "grounded"), ("a", "k4", 2, "1", "grounded"), ("a", "k5", 1, "5", "reconciled"), ("a", "zz", 0, "1", "grounded"),
    ]),
    "second_readings": ("doc string, key string, value string, grounded boolean", [("a", "k2", "9", True), ("a", "k3", "33", True), ("a", "k3", "32", True), ("a", "k4", "8", True), ("b", "k3", "3", True), ("b", "k6", "4", False), ("b", "k1", None, True)]),
    "proven_values": ("doc string, key string, value string", [("a", "k1", "11"), ("b", "k1", None), ("c", "k1", "1")]),
    "face_lines": ("doc string, line_no int, label string, value string", [("a", 1, "Revenue", "100"), ("a", 2, "Changes in inventories of goods", ""), ("a", 3, "CHANGES IN INVENTORIES of work", "(12)"), ("a", 4, "changes in inventory", "5"), ("b", 1, "Revenue", "3")]),
    "checked_rows": ("company string, section string, status string", [("acme", "ppe", "ok"), ("acme", "ppe", "miss"), ("acme", "loans", "mismatch"), ("acme", "loans", "ok"), ("acme", None, "miss"), ("bolt", "ppe", "false_positive"), ("bolt", "ppe", "ok"), ("dune", "equity", "mismatch"), ("dune", "equity", "ok"), ("dune", "equity", "ok")]),
    "schedule_pages": ("doc string, page int, rank int, text string", [
        ("a", 1, 1, "31 March 2026 and 2026\nLand 1 2 3 4 5\nLand 1 2 3 4 5\nLand 1 2 3 4 5"), ("a", 2, 2, "31 March 2025 and 2025\nLand 1 2 3 4 5\nLand 1 2 3 4 5\nLand 1 2 3 4 5"), ("a", 3, 9, "2030 2030"), ("b", 1, 1, "2024 2024\nBuildings 1 2 3 4 5\nPlant 1 2 3 4 5\nLand 1 2 3 4 5"), ("c", 1, 1, "2024 2024 torn"), ("d", 1, 1, None), ("e", 1, 1, "2024"),
    ]),
    "schedule_lines": ("doc string, page int, source int, line_no int, line string", [
        ("a", 1, 0, 1, "Land 100 5 105 10 1 11 94"), ("a", 1, 0, 2, "Office"), ("a", 1, 0, 3, "Equipment 50 10 5 55 20 4 2 22 33"), ("a", 1, 0, 4, "Total land 100 5 105 10 1 11 94"), ("a", 2, 0, 1, "Vehicles 10 1 11 2 1 3 8"), ("a", 2, 0, 2, "Land 90 10 100 9 1 10 90"), ("a", 3, 0, 1, "Computers 10 1 11 2 1 3 8"),
        ("b", 1, 0, 1, "Buildings 100 10 110 20 5 25 85 Buildings 110 10 120 25 5 30 90"), ("b", 1, 0, 2, "Plant 100 10 110 20 5 25 85 110 10 120 25 5 30 90"), ("b", 1, 0, 3, "Right-of-use land 100 5 105 10 1 11 94"), ("b", 1, 0, 4, None), ("c", 1, 0, 1, "Land 1 2 3 4 5 6 7"), ("c", 1, 1, 1, "Rules, 2024 Land 100 5 105 10 1 11 94"), ("d", 1, 1, 1, "Land 1 1 2 1 1 2 0"), ("e", 1, 1, 1, "Furniture 100 5 106 10 1 11 95"),
    ]),
    "tax_notes": ("doc string, page int, rank int, line_no int, line string", [
        ("a", 1, 1, 1, "Deferred tax balances"), ("a", 1, 1, 2, "On property, plant and equipment,"), ("a", 1, 1, 3, "allowances 100 20 (5) 115"), ("a", 1, 1, 4, "as told in note 7"), ("a", 1, 1, 5, "Leave encashment 10 2 12"), ("a", 1, 1, 6, "Total deferred tax liabilities 110 22 (5) 127"), ("a", 1, 1, 7, "Employee benefits 30 3 33"), ("a", 1, 1, 8, "Total deferred tax assets 30 3 33"),
        ("a", 2, 2, 1, "deferred tax prior year"), ("a", 2, 2, 2, "1 January"), ("a", 2, 2, 3, "Plant and property 80 20 100"), ("b", 1, 1, 1, "Leave 1 2 3"), ("c", 1, 1, 1, None), ("d", 1, 1, 1, "Deferred tax assets"), ("d", 1, 1, 2, "Leave pay 4 3"), ("d", 1, 1, 3, "Others 2 2"), ("d", 1, 1, 4, "Total deferred tax assets 6 5"),
    ]),
    "parent_rules": ("section string, word string", [("payables", "trade payable"), ("payables", "payables"), ("loans", "borrowing"), ("loans", "borrowing"), ("none", "nothing")]),
    "statements": ("id int, total_a string, total_b string, pbt string, tax string, pat string, income string, expense string, op string, inv string, fin string, fx string, net string, opening string, closing string", [
        (1, "1,000", "1,004", "100", "25", "75", "500", "400", "50", "(20)", "(10)", None, "20", "5", "25"), (2, "1,000", "1,006", "100", "25", "70", "500", "401", "50", "(20)", "(10)", "2", "90", "5", "97"),
        (3, "0", "0", "100", None, "75", "500", "300", None, None, None, None, "20", "5", "25"), (4, None, "5", None, None, None, None, None, "1", "1", "1", "1", "40", "1", "2"), (5, "(900)", "(902)", "-10", "(2)", "(8)", "5", "15", "10", "5", "5", "-1", "19", "1", "20"),
    ]),
    "page_tags": ("doc string, page int, signal string", [("a", 1, None), ("a", 2, "STANDALONE"), ("a", 3, None), ("a", 4, "CONSOLIDATED"), ("a", 5, None), ("a", 9, "STANDALONE"), ("b", 1, "CONSOLIDATED"), ("b", 2, None), ("b", 5, None), ("b", 6, "CONSOLIDATED"), ("c", 1, None)]),
    "reads": ("item string, n int, found boolean, value string", [("x", 1, True, "1,000"), ("x", 2, True, "1000.00"), ("x", 3, True, "900"), ("y", 1, True, "abc"), ("y", 2, True, "7"), ("y", 3, False, None), ("z", 1, False, None), ("w", 1, True, "Nil "), ("w", 2, True, "nil")]),
    "items": ("page int, item int, y double, x0 double, x1 double", [(1, 1, 100.0, 10.0, 50.0), (1, 2, 200.0, 60.0, 90.0), (2, 1, 50.0, 0.0, 10.0), (2, 2, 90.0, 5.0, 95.0)]),
    "headings": ("page int, ord int, hy double, hx0 double, hx1 double, heading string", [(1, 1, 20.0, 0.0, 100.0, "Assets"), (1, 2, 95.0, 0.0, 40.0, "Equity"), (1, 3, 95.0, 0.0, 45.0, "Reserves"), (1, 4, 150.0, 55.0, 95.0, "Loans"), (2, 1, 60.0, 0.0, 90.0, "Tax"), (2, 2, 92.0, 90.0, 99.0, "Cash")]),
    "segments": ("page int, segment int, x0 double, x1 double", [(1, 1, 0.0, 10.0), (1, 2, 8.0, 30.0), (1, 3, 28.0, 32.0)]),
    "columns": ("page int, col int, e0 double, e1 double", [(1, 1, 0.0, 9.0), (1, 2, 9.0, 30.0), (1, 3, 30.0, 60.0)]),
    "marks": ("page int, a int, x double", [(1, 1, 10.0), (1, 2, 33.0), (1, 3, 41.0), (2, 1, 5.0)]),
    "centres": ("page int, b int, c double", [(1, 1, 12.0), (1, 2, 38.0), (1, 3, 200.0), (2, 1, 80.0)]),
    "blocks": ("id int, nums array<double>", [(1, [100.0, 20.0, 5.0, 115.0]), (2, [40.0, 10.0, 50.0]), (3, [100.0, 20.0, 99.0]), (4, [5.0]), (5, [37869.0, -334.0, 37535.0]), (6, [1843.74, 97.91, -439.69, 1501.96]), (7, [296.0, -62.0, 234.0]), (8, [1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0])]),
    "aliases": ("alias string", [("Trade payables",), ("Legal and professional charges",), ("Interest on loans",), ("Reserves",), ("Trade payables",), ("of the",)]),
    "report_lines": ("page int, line_no int, line string", [(1, 1, "Trade payable 12 1,234 1,100"), (1, 2, "Legal & professional charges 55"), (1, 3, "legal and other professional charge 3"), (1, 1, "Trade payable 12 1,234 1,100"), (2, 1, "Interest paid on term loan 9,876.5"), (2, 2, "Reserve and surplus 4"), (2, 3, "# Note 5"), (2, 4, "|a|b|"), (2, 5, "|---|---|"), (2, 6, "| 1 | 2 |"), (2, 7, "end"), (2, 8, "|c|d|"), (3, 1, "**Cash flows**:"), (3, 2, "  "), (3, 3, "|a|**b**|"), (3, 4, "| :-- | --: |"), (3, 5, "||x|"), (3, 6, "|5|6"), (3, 7, "|one|"), (3, 8, "|two|"), (4, 1, "|p|q|"), (4, 2, "|---|---|"), (4, 3, "|r|s|t|")]),
    "cells": ("page int, cell string", [(1, "1,234"), (1, "55"), (2, "(9,876.50)")]),
    "moves": ("item string, id int, opening double, closing double", [("dep", 1, 100.0, 120.0), ("dep", 2, 120.0, 140.0), ("dep", 3, 300.0, 310.0), ("tax", 1, 5.0, 6.0), ("tax", 2, 9.0, 5.01)]),
    "components": ("note int, value double, total double, parent double", [(1, 10.0, 30.0, 30.2), (1, 20.0, 30.0, 30.2), (2, 10.0, 30.0, 30.0), (2, None, 30.0, 30.0), (3, 5.0, 5.0, None)]),
    "concepts": ("key string, hint string, scope string", [("Share Premium", "other equity note", "both"), ("Total Power & Fuel Expenses", "other expenses", "both"), ("Share Depreciation Joint ventures", "consolidated notes", "consolidated"), ("Sundry Creditors", "trade payables note", "standalone"), ("Unknown", None, "both"), ("Bad Debts", "P&L other expenses", "both")]),
    "found_tables": ("doc string, page int, n int, scope string, section string, title string", [("a", 1, 1, "s", "Balance Sheet", "x"), ("a", 2, 1, "s", "balance sheet ", "y"), ("a", 4, 1, "s", "Balance Sheet", "z"), ("a", 4, 2, "s", "", "Loans: long/short"), ("a", 5, 1, "s", "", ""), ("b", 1, 1, "c", "A very long section title that has no end", "t"), ("b", 1, 1, "c", "A very long section title that has no end", "u")]),
    "report_pages": ("doc string, page int, text string", [
        ("a", 1, "Contents\nOverview 4\nBoard report 12\nBalance sheet 20\nNotes 31\nRatios 44 .\nGlossary 51\nIndex ..... 60\nNotice 66"),
        ("a", 2, "Letter to members\nas per the Consolidated Statement of Cash Flows we did well\nTotal income rose for the year"),
        ("a", 3, "INDEPENDENT AUDITOR'S REPORT\nReport on the standalone statements"),
        ("a", 4, "Standalone Balance Sheet as at 31 March 2026\nNon-current assets 10\nTotal assets 1,000\nEquity and liabilities\nTotal equity and liabilities 1,000"),
        ("a", 5, "Statement of Profit and Loss for the year ended\nRevenue from operations 9\nTax expense 1"),
        ("a", 6, "Notes to the Standalone Financial Statements\nNote 12. Other expenses\nPower 5\nLegal 6"),
        ("a", 7, "Notes to the Consolidated Financial Statements\nsegments"),
        ("a", 8, "Company   Consolidated Balance Sheet as at 31 March 2026\nTotal equity 5\nCapital & Liabilities 1\ndeposits"),
        ("a", 9, "x\n\n  Consolidated Balance Sheet\nas at 31 March\nTotal equity 7"),
        ("a", 10, "31 Other items\nsome words 31. Other expenses 44\nShare capital: authorised, issued, subscribed and paid-up equity shares"),
        ("b", 1, "Balance Sheet as on 31 March\nCAPITAL & LIABILITIES\nDeposits 5\nTotal assets 4\nTotal liabilities 4\nFinancial assets\nDebt securities"),
        ("b", 2, "Cash flow from operating activities\nshare capital authorized issued equity"),
        ("b", 3, ""),
        ("c", 1, "Sources of funds\nPolicyholders' funds\nApplication of funds"),
        ("c", 2, "Revenue account\nforming part of the consolidated financial statements\nStatement of cash flows for the year"),
        ("d", 1, "Balance Sheet as at 1 April\nTotal equity and more"),
        ("d", 2, "Forming part of the consolidated financial statements"),
        ("d", 3, "plain"),
    ]),
    "note_refs": ("doc string, ref string, title string", [("a", "12", "other expenses"), ("a", "31", "other expenses"), ("a", "2", "other expenses"), ("b", "1", "deposits")]),
    "reflows": ("page int, before string, after string", [(1, "a 1,000 b 5 c 5", "b 5 a 1000 c 5"), (2, "a 7 b 7", "a b 7"), (3, "x 1", None), (4, "no numbers", ""), (5, "", "1")]),
    "read_values": ("id int, value string, evidence string, is_count boolean", [
        (1, "` 1.00", "Total 1.00 2.00", False), (2, "12.5*", "Loss (12.5) 3", False), (3, "7", "( 7 ) and 7", False), (4, "7", "17 (7) 7.5", False), (5, "(9)", "(9)", False), (6, "Nil", "Nil", False), (7, "₹", None, False),
        (8, "404", "(404)", True), (9, "Rs. 5,000.25", "x (5,000.25) y (5,000.25)", False), (10, None, "(3)", False), (11, "", "", False), (12, "INR 8 #", None, False), (13, "3.5", "(3x5)", False)]),
    "seen_cells": ("id int, cell string", [(i, c) for i, c in enumerate(["1,234", "Note 5", "abc", "", None, "(12.5)", "FY24 x9y", "12b", "a1", "–", "nil", "{}©ab", "plain text", " - ", "NIL", "1st"])]),
    "definitions": ("id int, meaning string, selector string", [(1, "payables — total trade payables", None), (2, "the sub-total of x", ""), (3, None, "TOTAL trade payables"), (4, "Return the total", "x"), (5, "only one line", "subtotal"), (6, None, None), (7, "x", "the note's total"), (8, "totals", "totally")]),
    "addends": ("id int, adds array<string>, source string", [(1, ["1,000", "(250)"], "a 1,000 b (250)"), (2, ["100.5", "200.25", "x"], "100.5 and 200.25"), (3, ["100"], "100"), (4, ["12", "345"], "12 345"), (5, [], "x"), (6, ["-900", "` 100.004"], "900 100.004"), (7, ["111", "999"], "111 only")]),
    "face_labels": ("id int, label string", [(1, "III Total Income (I+II)"), (2, "Sub-total income"), (3, "Total non-current assets"), (4, "TOTAL ASSETS"), (5, "Total income"), (6, "Grand total income"), (7, "Totals")]),
    "results_grid": ("sheet int, row_no int, cells array<string>", [
        (1, 1, ["Total income", "1,000", "900"]), (1, 2, ["Total expenses", "800", "700"]), (1, 3, ["Profit before tax", "200", "200"]), (1, 4, ["Total tax expense", "50", "50"]), (1, 5, ["Profit for the period", "150", "150"]),
        (1, 6, ["Remeasurement", "5", "6"]), (1, 7, ["Hedges", "(2)", "-"]), (1, 8, ["Total other comprehensive income", "3", "6"]), (1, 9, ["Total comprehensive income", "153", "156"]),
        (2, 1, ["Total income", "1,000", "900"]), (2, 2, ["Total expenses", "800", "700"]), (2, 3, ["Profit before tax", "260", "200"]), (2, 4, ["Tax expense: current", "10", "10"]), (2, 5, ["Tax expense", "50", "50"]), (2, 6, ["Profit for the year", "210", "150"]),
        (3, 1, ["Segment", "1", "2"]), (3, 2, ["Other", None, ""]),
        (4, 1, ["Total income", "1,000"]), (4, 2, ["Total expenses", "800"]), (4, 3, ["Finance and other income", "40"]), (4, 4, ["Finance expenses", "10"]), (4, 5, ["Share of net profit", "20"]), (4, 6, ["Profit before tax", "250"])]),
    "asset_rows": ("id int, nums array<double>", [(1, [100.0, 20.0, 5.0, 115.0, 10.0, 5.0, 15.0, 100.0]), (2, [10.0, 10.0, 4.0, 4.0, 6.0]), (3, [1.0, 2.0]), (4, [100.0, 100.0, 30.0, 30.0, 60.0]), (5, [])]),
    "targets": ("id int, value double, total double, comps array<double>, total_wanted boolean", [(1, 100.0, 100.2, [60.0, 40.0], False), (2, 100.0, 100.0, [100.0, 0.0], False), (3, 100.0, 100.0, [60.0, 40.0], True), (4, 60.0, 100.0, [60.0, 40.0], False), (5, None, 100.0, [60.0, 40.0], False)]),
    "tax_lines": ("page int, line_no int, line string", [(1, i, t) for i, t in enumerate(["Note 9", "Deferred tax liabilities", "Depreciation and", "amortisation 100.5 90.0", "Provisions 20.0 10.0", "Gross deferred tax liabilities 120.5 100.0", "Deferred tax assets", "Leave 5.0 6.0", "Other 1.0 1.0", "Total deferred tax assets 7.5 7.0", "x", "Losses 3.0 2.0", "Total deferred tax assets 3.0 2.0"])] + [(2, 0, "A 1.0 2.0"), (2, 1, "B 1.0 2.0"), (2, 2, "C 1.0 2.0"), (2, 3, "Total deferred tax asset 2.0 4.0")]),
    "answers": ("id int, doc string, page int, value string, quote string", [(1, "a", 2, "1,000", None), (2, "a", 4, "1000", "x"), (3, "a", None, "7", "Power 5"), (4, "b", 1, "12345", "no such quote"), (5, "c", 9, None, "Policyholders' FUNDS"), (6, "c", None, None, None)]),
    "answer_pages": ("id int, page int, rank int", [(1, 6, 1), (1, 4, 2), (2, 5, 1), (3, 5, 1), (3, 6, 2), (4, 2, 1), (5, 2, 1), (5, 1, 2), (6, 1, 1)]),
    "summaries": ("id int, summary string, source string, cells array<string>", [(1, "Revenue rose 12% to ₹1,234.5 from (987)", "rev 1234.5 then 987", ["1,234.5", "12", "x", None]), (2, "2,000 and 2,000 and 45", "none", ["2,000"]), (3, "no figures", "", []), (4, "$555 555", "long " * 50 + "55", ["555"])]),
    "confidences": ("doc string, id int, confidence string, section string, status string", [("a", 1, "reconciled", "investments", "tie"), ("a", 2, "grounded", "ppe", "absent"), ("b", 3, "absent", "investments", "absent"), ("b", 4, "unverified", "ppe", "absent"), ("c", 5, "grounded", "investments", "tie"), ("c", 6, "reconciled", "tax", "no-tie")]),
    "taxonomy": ("key string, concept string, column_hint string, aliases array<string>, scope string", [("Share Premium", "old", None, ["Premium"], "both"), ("Other CWIP", "cwip", "closing", None, "consolidated"), ("Bad Debts", "debts", None, ["Bad debts", "Write-offs"], "standalone"), ("Unlisted", "u", None, [], "both")]),
    "audit": ("key string, severity string, suggested_concept string, suggested_column_hint string, suggested_aliases string", [("share  premium", "major", "new ", "", "Securities premium; Premium | Share premium"), ("OTHER CWIP", "ok", "x", "y", "z"), ("Bad Debts", "Minor", "other", None, None)]),
    "profiles": ("company string, na_items array<string>, has_consolidated boolean", [("acme", ["Bad Debts"], True), ("bolt", None, False)]),
    "page_grids": ("doc string, page int, n int, grid array<array<string>>", [("a", 1, 1, [["x", "1,0"], ["y", "2"]]), ("a", 1, 2, [["q", "10"], ["z", "2"], ["t", ""], ["w", "7"]]), ("a", 1, 3, [["x", "11"]]), ("a", 2, 1, [["x", "10"], ["y", "2"]]), ("b", 1, 1, [["x", None], ["y", ""]]), ("b", 1, 2, [["only words"]])]),
    "face_pages": ("doc string, page int, text string", [
        ("a", 1, "Balance Sheet as at 31 March 2026\nProperty, plant and equipment   3   500.00   450.00\nGoodwill   10.00   10.00\nInvestments   4   90.00   80.00\nDeferred tax assets (net)  5  -  2.00\nInventories   100.00   90.00\nTrade receivables   6   200.00   180.00\nCash and cash equivalents   100.00   88.00\nTOTAL ASSETS   1,000.00   900.00\nEquity share capital   7   50.00   50.00\nOther equity   8   450.00   400.00\nBorrowings   9   300.00   280.00\nTrade payables (2,0)   200.00   170.00\nTotal Equity and Liabilities   1,002.00   900.00"),
        ("a", 2, "Statement of Profit and Loss for the year ended\nI   Revenue from operations   1,000.00   900.00\nII   Other income   50.00   40.00\nIII Total Income (I+II)   1,050.00   940.00\nCost of materials consumed   20   500.00   450.00\nEmployee benefits   100.00   90.00\nFinance costs   21   50.00   40.00\nOther expenses   22   200.00   160.00\nTotal expenses   850.00   740.00\nProfit before tax   200.00   200.00\nTax expense   50.00   50.00\nProfit for the year   150.00   150.00"),
        ("b", 1, "BALANCE SHEET AS AT 31 MARCH\nCAPITAL & LIABILITIES\nItem a words  10.00  10.00\nItem b words  20.00  20.00\nItem c words  30.00  30.00\nItem d words  40.00  40.00\nTOTAL  100.00  90.00\nDeposits held  60.00  50.00\nLoans given  40.00  40.00\nTotal  100.00  90.00"),
        ("c", 1, "Balance Sheet as at 31 March 2026\nProperty, plant and equipment   3   500.00   450.00\nGoodwill   10.00   10.00\nInvestments   4   90.00   80.00\nDeferred tax assets (net)  5  -  2.00\nInventories   100.00   90.00\nTrade receivables   6   200.00   180.00\nCash and cash equivalents   100.00   88.00"),
        ("c", 2, "TOTAL ASSETS   1,000.00   900.00\nEquity share capital   7   50.00   50.00\nOther equity   8   450.00   400.00\nBorrowings   9   300.00   280.00\nTrade payables (2,0)   200.00   170.00\nTotal Equity and Liabilities   1,002.00   900.00"),
        ("d", 1, "Balance Sheet as at 31 March 2026\nProperty, plant and equipment   3   500.00   450.00\nGoodwill   10.00   10.00\nInvestments   4   90.00   80.00\nDeferred tax assets (net)  5  -  2.00\nInventories   100.00   90.00\nTrade receivables   6   200.00   180.00\nCash and cash equivalents   100.00   88.00\nTOTAL ASSETS   1,000.00   900.00\nEquity share capital   7   50.00   50.00\nOther equity   8   450.00   400.00\nBorrowings   9   300.00   280.00\nTrade payables (2,0)   200.00   170.00\nTotal Equity and Liabilities   1,200.00   900.00"),
    ]),
    "words": ("doc string, page int, x0 double, y0 double, x1 double, y1 double, word string", [
        ("a", 1, x, y + dy, x + 7.0 * len(t), y + dy + 10.0, t)
        for y, row in ((50.0, [(10.0, "Schedule"), (70.0, "of"), (88.0, "assets")]), (80.0, [(10.0, "Land"), (200.0, "1,000"), (300.0, "900")]), (95.0, [(10.0, "Plant"), (50.0, "and"), (75.0, "tools"), (200.0, "2,500.5"), (300.0, "40")]), (110.0, [(10.0, "Other")]),
                       (125.0, [(10.0, "Cars"), (200.0, "(7)"), (300.0, "8")]), (140.0, [(10.0, "Total"), (200.0, "3,493.5"), (300.0, "948")]), (230.0, [(10.0, "Notes"), (60.0, "follow")]))
        for (x, t), dy in zip(row, (0.0, 1.5, -1.0, 0.5, 0.0))] + [("b", 1, 5.0, 6.0, 20.0, 16.0, "alone"), ("b", 1, 5.0, 10.0, 9.0, 14.0, "x")]),
    "proposals": ("doc string, ord int, year int, item string", [("a", 1, 2025, "x"), ("a", 2, 2024, "y"), ("a", 3, 2025, "x"), ("a", 4, 2024, "z"), ("b", 1, 2020, "x"), ("b", 2, None, "q"), ("c", 1, None, "q")]),
    "payloads": ("id int, payload string, text string", [
        (1, '[{"key":"x","present":true,"value":"` 1,234","evidence":"x (1,234)"},{"key":"y","present":true,"value":"9","addends":["1,000","(250)"]},{"key":"z","present":false}]', "x (1,234) and 1,000 with 250"),
        (2, '[{"key":"x","present":true,"value":"-"},{"key":"w","present":true,"value":"777","evidence":""}]', "nothing here"), (3, "not json", "t"), (4, None, None)]),
    "note_targets": ("doc string, window int, key string, value string, total double, comps array<double>, evidence string, doc_year int, wanted boolean, reconciled boolean", [
        ("a", 1, "x", "10", 100.0, [60.0, 40.0], "x 10 in 2026", 2026, False, True), ("a", 1, "y", "100", 100.0, [60.0, 40.0], "", 2026, False, True), ("a", 2, "x", "10", 100.0, [60.0, 40.0], None, 2026, False, True), ("a", 2, "y", "100", 100.0, [60.0, 40.0], "", 2026, True, True),
        ("a", 3, "x", "1", 1.0, [1.0], "", 2026, False, False), ("b", 1, "x", "5", 9.0, [5.0, 4.0], "2023 and 2024", 2025, False, True), ("b", 2, "x", None, 9.0, [5.0, 4.0], "", 2025, False, True)]),
    "calls": ("company string, tokens_in int, tokens_out int", [("acme", 1000, 200), ("acme", 5000, 10), ("bolt", 1, 1)]),
    "alias_keys": ("key string, alias string", [("tp", "Trade payables"), ("lp", "Legal and professional charges"), ("lp", "Legal charges"), ("rs", "Reserves")]),
    "year_lines": ("doc string, ord int, txt string", [("a", 1, "As at 31 March 2026 and 31 March 2025, lease to 2040"), ("a", 2, "2026 2025"), ("b", 1, "2024 2024 2023"), ("b", 2, "none"), ("c", 1, "2031 2030 2030 1999")]),
    "printed_lines": ("id int, line string, words array<string>", [(i, t, t.split()) for i, t in enumerate([
        "5. RIGHT-OF-USE ASSETS", "SCHEDULE 2 - RESERVES AND SURPLUS", "B. Other Equity", "M. Sanaulla Khan Company Secretary", "X. Row marker", "12) 1,234 5,678 9", "230 STATUTORY REPORTS AND FINANCIAL STATEMENTS", "42", "1234567",
        "(₹ in millions, unless otherwise stated)", "Rupees crores", "Annual Report 2026", "CORPORATE OVERVIEW STATUTORY REPORTS", "Total 5,568 4,968", "Total - nil", "Loans and advances to others 12", "a b", "Total 1 2 3 4 5 6 7 8", "7. Loans (in crores)", "Ab", "C. It's A-B, (x)", "D. one two three four five", "", "Trade receivables 10 20"])]),
    "row_words": ("id int, rows array<string>", [(1, ["1 2", "3 -", "nil 4", "(5) 6"]), (2, ["1 2", "3 -", "label 4", "5 6", "7 8"]), (3, []), (4, ["x", "1", "2", "3", "4 5 6 7 y"]), (5, ["1", "", "2", "3", "4"])]),
    "wanted_items": ("key string, selector string, value_type string, examples array<string>", [("a", None, "monetary", ["x"]), ("b", "Gross block", "monetary", ["x"]), ("c", "the ACCUMULATED column", None, ["x"]), ("d", "net", "count", ["x"]), ("e", "net", "monetary", []), ("f", "", "per_share", ["x", "y"]), ("g", None, None, None)]),
    "results": ("company string, scope string, key string, found boolean, value string, status string", [
        ("acme", "standalone", "Share Premium", True, "1,003", None), ("Acme", "standalone", "Hedging Reserve", True, "50", ""), ("acme", "consolidated", "Other CWIP", False, None, None), ("acme", "consolidated", "Bad Debts", False, None, "N/A (sector)"),
        ("bolt", "standalone", "Equity Issued", True, "4.5", None), ("bolt", "standalone", "Unlisted", True, "1", None), ("bolt", "consolidated", "Equity Issued", False, None, None)]),
    "gold": ("company string, scope string, key string, expected string, ord int", [
        ("acme", "Standalone ", " Share Premium", "999", 1), ("ACME", "standalone", "Share Premium", "1,004", 2), ("acme", "standalone", "Hedging Reserve", "(52)", 3), ("acme", "consolidated", "Other CWIP", "Not disclosed", 4), ("acme", "consolidated", "Bad Debts", "7", 5),
        ("bolt", "standalone", "Equity Issued", "45", 6), ("bolt", "consolidated", "Equity Issued", "12", 7)]),
    "adjudicated": ("key string, scope string, verdict string, true_value string", [("Share Premium", "standalone", "GT_WRONG", "1,005"), ("Other CWIP", "consolidated", "BOTH_NOT_DISCLOSED", None), ("Bad Debts", "both", "PIPELINE_WRONG", "7"), ("Nowhere", "x", None, None), ("Unlisted", "standalone", "MATCH_BOTH", "1")]),
    "questions": ("id int, doc string, question string", [(1, "a", "What are total ASSETS and net profit?"), (2, "a", "Cash from operating activities"), (3, "b", "Earnings per share"), (4, "a", "Who audits?"), (5, "c", "Borrowings"), (6, "a", None)]),
    "located": ("doc string, kind string, page int", [("a", "bs", 4), ("a", "pl", 5), ("a", "cf", 9), ("b", "bs", 1), ("b", "pl", 2)]),
    "asset_nets": ("doc string, note int, net double, parent double", [("a", 1, 60.0, 100.5), ("a", 1, 40.0, 100.5), ("a", 2, 60.0, 103.0), ("a", 2, None, 103.0), ("b", 1, None, 5.0), ("b", 2, 5.0, None), ("b", 3, 0.5, 0.0)]),
    "odd_grids": ("id int, grid array<array<string>>", [(1, [["{}$©", "10", ""], ["Deposits", "", " "], ["Loans", "5", "6"]]), (2, [["{}$©", "10"], ["Deposits", "7"]]), (3, [["{}$©", "x"], ["Deposits", ""]]), (4, [["plain", "1"], ["Deposits", ""]]), (5, []), (6, [["{}$©", "1"]])]),
    "asset_pages": ("doc string, page int, rank int, text string", [
        ("a", 7, 1, "Land   Buildings   Plant   Vehicles   Total\nGross carrying value\nAs at 1 April 2024   1 2 3 4 10\nAs at 31 March 2025   2 3 4 5 14\nAccumulated depreciation\nAs at 31 March 2025   1 1 1 1 4\nNet block as at 31 March 2025   1 2 3 4 10"),
        ("a", 6, 2, "Particulars        Office\n   Land   Buildings   equipment   Total\nGross carrying value\nAs at 1 April 2025   2 3 4 9\nAs at 31 March 2026   5 (6) - 7 3\nAs at 31 March 2026   8 8 8 8\nAccumulated depreciation\nAs at 31 March 2026   0 1 2 3\nCarrying value as at 31 March 2026   5 5 5 15"),
        ("a", 9, 3, "Total   Land   Buildings   Plant\n1 2 3 4 5\n1 2 3 4 5\n2026 1 2 3 4\ncarrying value"),
        ("b", 1, 1, "no table\nLand\n5"), ("b", 2, 2, None),
        ("b", 3, 3, "gross block and accumulated depreciation\nLand\nBuildings\nPlant and\nOffice\nx 1 2 3 4"), ("b", 4, 4, "accumulated depreciation policy\nland buildings"), ("b", 5, 5, "gross block accumulated depreciation\nLand\nBuilding\nPlant\nOffice\nland 1 2 3 4\nplant 1 2 3 4\noffice 1 2 3 4")]),
    "chapter_pages": ("doc string, page int, text string", [
        ("title", 1, "Contents\n" + "\n".join(f"Part {i} {i}" for i in range(9)) + "\nManagement Discussion 4"), ("title", 2, "x\nManagement Discussion and Analysis\nprose"), ("title", 3, "more"), ("title", 4, "Management discussion | corporate governance"), ("title", 5, "Corporate Governance Report"), ("title", 6, "end"),
        ("ribbon", 1, "Management Discussion"), ("ribbon", 2, "BRSR"), *[("ribbon", i, "body\nReports  |  Management   Discussion and Analysis") for i in (4, 5, 7, 12)], ("ribbon", 13, "z"),
        ("heading", 1, "cover"), ("heading", 2, "1\n2\n3\n4\n5\n6\n7\n8\nMANAGEMENT DISCUSSION AND ANALYSIS\nNEXT ENTRY"), ("heading", 3, "a\n\n  MANAGEMENT DISCUSSION AND ANALYSIS REPORT OF THIS YEAR TOO\n" + "the year was one of steady growth in every one of our segments"), ("heading", 4, "on"), ("heading", 5, "RESPONSIBILITY STATEMENT OF DIRECTORS"), ("heading", 6, "x"),
        ("short", 1, "Management Discussion"), ("short", 2, "Financial statements"), ("short", 3, "Management discussion of much else that is too long for a title"), ("none", 1, "nothing"), ("none", 2, None)]),
    "reports": ("doc string", [("a",), ("b",), ("c",)]),
    "statement_candidates": ("doc string, kind string, page int, rank int", [("a", "bs", 4, 1), ("a", "bs", 8, 2), ("a", "pl", 5, 1), ("a", "cf", 6, 1), ("b", "bs", 1, 1), ("b", "pl", 2, 1), ("b", "pl", 3, 2)]),
    "statement_payloads": ("doc string, kind string, page int, attempt int, payload string", [
        ("a", "bs", 4, 1, '{"grand_total_a": "1,000", "grand_total_b": "1,100", "unit": "crore"}'), ("a", "bs", 8, 1, '{"grand_total_a": "2,000", "grand_total_b": "900"}'), ("a", "bs", 8, 2, '{"grand_total_a": "2,000", "grand_total_b": "2,000", "unit": "lakh", "scope": "consolidated"}'),
        ("a", "pl", 5, 1, '{"profit_before_tax": "100", "tax_total": "25", "profit_for_year": "75"}'), ("a", "pl", 5, 2, '{"profit_before_tax": "101", "tax_total": "25", "profit_for_year": "76"}'), ("a", "cf", 6, 1, "no JSON"),
        ("b", "bs", 1, 1, None), ("b", "pl", 3, 1, '{"total_income": "500", "total_expenses": "400", "profit_before_tax": "101"}')]),
    "whole_payloads": ("doc string, payload string", [
        ("a", '{"unit": "crore", "scope": "standalone", "bs_total_assets": "100", "bs_total_equity_and_liabilities": "100", "pl_total_income": "5", "cf_net_change": ""}'), ("b", "broken"), ("c", None),
        ("d", '{"cf_net_operating": "50", "cf_net_investing": "(20)", "cf_net_financing": "(10)", "cf_net_change": "20"}')]),
    "parsed_lines": ("doc string, page int, line_no int, label string, ref string, value string", [("a", 1, 3, "Total assets", None, "10"), ("a", 1, 2, "Loans", "4", "3")]),
    "line_answers": ("doc string, payload string", [("a", '[{"label": "unused", "value": "1"}]'), ("e", '[{"label": "Loans", "note_ref": "4", "value": "(5)"}, {"label": "Cash", "value": "7"}]'), ("f", "no JSON"), ("g", None)]),
    "target_payloads": ("doc string, window int, payload string", [
        ("a", 1, '[{"key": "x", "present": true, "value": "10", "evidence": "x (10)"}, {"key": "y", "present": false}]'), ("a", 2, '[{"key": "x", "present": true, "value": "` 12", "evidence": "x 12"}, {"key": "y", "present": true, "value": "3"}]'),
        ("a", 3, '[{"key": "x", "present": true, "value": "1"}, {"key": "y", "present": true, "value": "2"}]'), ("b", 1, '[{"key": "x", "present": true, "value": "-"}]'), ("c", 1, "no JSON")]),
    "category_payloads": ("doc string, payload string", [("a", '[{"key": "bonds", "present": true, "lines": [{"label": "p", "value": "1,000"}, {"label": "q", "value": "(250)"}, {"label": "r", "value": "x"}]}, {"key": "ventures", "present": false, "lines": [{"label": "p", "value": "5"}]}, {"key": "none", "present": true}]'), ("b", None)]),
    "section_pages": ("doc string, page int, scope string, statement string, units string", [("a", 1, "standalone", "Balance Sheet", "crore"), ("a", 2, "standalone", None, None), ("a", 3, "consolidated", None, None), ("a", 4, "consolidated", "Cash flow statement", "lakh"), ("b", 1, None, None, None)]),
    "section_headings": ("doc string, page int, y double, heading string", [("a", 1, 50.0, "1. Loans"), ("a", 2, 80.0, "2. Cash"), ("a", 3, 90.0, "3. Equity"), ("a", 9, 1.0, "elsewhere"), ("b", 1, 30.0, "A. Notes")]),
    "section_tables": ("doc string, page int, n int, y double, own string", [("a", 1, 1, 20.0, None), ("a", 1, 2, 50.0, None), ("a", 2, 1, 10.0, None), ("a", 2, 2, 60.0, "Profit and loss"), ("a", 2, 3, 70.0, None), ("a", 2, 4, 100.0, None), ("a", 3, 1, 10.0, None), ("a", 3, 2, 95.0, None), ("a", 4, 1, 5.0, None), ("b", 1, 1, 20.0, None)]),
}


#: The folder of the given tables while a query is built from them.
FOLDER: ContextVar[str] = ContextVar("folder", default="")


def table(spark: SparkSession, name: str) -> DataFrame:
    """A table of the engine's shapes: derived from the given tables within a query, else the small one."""
    if FOLDER.get() and name in given.GIVEN:
        return given.in_spark(spark, FOLDER.get(), name)
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v, kind: str) -> str:
    if v is None:
        return f"NULL::{_type(kind)}"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(_literal(x, kind[6:-1]) for x in v) + f"]::{_type(kind)}"
    return f"{v}::DOUBLE" if kind == "double" else str(v)


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _type(kind: str) -> str:
    return _type(kind[6:-1]) + "[]" if kind.startswith("array<") else _TYPES[kind]


def values(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the tables."""
    parts = []
    for name in names:
        if name in given.GIVEN:
            parts.append(f"{name} AS ({given.as_sql(name)})")
            continue
        schema, rows = TABLES[name]
        columns = [c.split(" ") for c in schema.split(", ")]
        body = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(r, columns)) + ")" for r in rows)
        parts.append(f"{name}({', '.join(f'"{c}"' for c, _ in columns)}) AS (VALUES {body})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)
