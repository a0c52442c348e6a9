"""Sections of a report's notes: what they are called and the words that find their pages."""

from __future__ import annotations

# Each section's label, and the words by which its pages are ranked.
SECTIONS = {
    "other_equity": ("Other Equity / Reserves note", "other equity reserves and surplus securities premium retained earnings general reserve capital reserve hedging reserve statement of changes in equity closing balance"),
    "investment_property": ("Investment Property note", "investment property gross carrying amount cost accumulated depreciation"),
    "investments": ("Investments note (non-current & current)", "investments non-current current quoted unquoted equity instruments debentures bonds joint ventures associates partnership firms"),
    "ppe": ("Property, Plant & Equipment movement schedule (and CWIP)", "property plant and equipment gross carrying value cost accumulated depreciation additions disposals net carrying capital work in progress furniture fixtures office equipment"),
    "trade_payables": ("Trade Payables note", "trade payables micro small and medium enterprises MSME other than creditors"),
    "borrowings": ("Borrowings notes (non-current & current, secured & unsecured)", "borrowings non-current current secured unsecured loans debentures term loans subordinated debt deferred payment from related parties from others"),
    "other_nc_liabilities": ("Other Non-current Liabilities note", "other non-current liabilities long term other long term liabilities total"),
    "other_cur_liabilities": ("Other Current Liabilities note", "other current liabilities revenue received in advance unearned accrued salary payable employee stock options outstanding"),
    "loans_advances": ("Loans & Advances / Other Financial Assets note", "loans advances security deposits related parties allowance for bad and doubtful other current financial assets short term"),
    "other_cur_assets": ("Other Current Assets note", "other current assets advances to related parties advances to suppliers export incentives receivable doubtful advances"),
    "share_capital": ("Share Capital note", "share capital authorised issued subscribed paid up equity shares face value reconciliation of shares outstanding buyback treasury stock split"),
    "finance_costs": ("Finance Costs note", "finance costs interest expense on borrowings interest on debt"),
    "other_expenses": ("Other Expenses note (P&L)", "other expenses power and fuel consumption of stores and spare parts brokerage commission carriage outwards legal and professional payment to auditor donations csr corporate social responsibility bad debts written off provision doubtful impairment"),
    "deferred_tax": ("Deferred Tax note", "deferred tax assets liabilities components net movement"),
    "pl_changes_inventory": ("Statement of Profit & Loss (changes in inventories line)", "changes in inventories of finished goods work in progress stock in trade"),
    "consolidated_equity": ("Consolidated equity / interests in joint ventures", "equity attributable to owners of the company non-controlling interest interests in joint ventures depreciation"),
}
