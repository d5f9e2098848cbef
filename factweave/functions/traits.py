"""What kind of contract it is: one wide projection of literal tests over its text, to be computed once and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import contains_all, contains_any

# Trait, any of these words, all of these words; text is compared in lower case.
TRAITS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "is_amm": (("getreserves", "swapexacttokens", "addliquidity", "uniswap"), ()),
    "is_erc20": ((), ("transferfrom", "allowance", "totalsupply")),
    "is_erc721": (("ownerof(", "safetransferfrom", "erc721"), ("tokenid",)),
    "is_erc1155": (("erc1155", "safebatchtransferfrom"), ()),
    "is_erc4626": (("erc4626", "converttoshares", "previewdeposit"), ()),
    "is_vault": (("vault", "totalassets"), ("deposit", "withdraw")),
    "is_proxy": (("delegatecall", "_implementation", "erc1967"), ("implementation",)),
    "is_upgradeable": (("upgradeable", "upgradeto", "_authorizeupgrade"), ()),
    "is_diamond": (("diamondcut", "facet", "libdiamond"), ()),
    "is_bridge": (("bridge", "crosschain", "layerzero", "relaymessage"), ()),
    "is_oracle_consumer": (("latestrounddata", "latestanswer", "getprice("), ()),
    "is_lending": (("borrow(", "liquidate"), ("collateral",)),
    "is_staking": (("stake(", "unstake", "stakingtoken"), ()),
    "is_restaking": (("restak", "eigenlayer", "slasher"), ()),
    "is_governance": (("propose(", "castvote", "governor"), ()),
    "is_multisig": (("threshold", "required"), ("owners",)),
    "is_timelock": (("timelock", "mindelay"), ()),
    "is_flash_lender": (("flashloan", "onflashloan", "flashfee"), ()),
    "is_paymaster": (("paymaster", "validatepaymasteruserop"), ()),
    "is_account": (("validateuserop", "useroperation", "entrypoint"), ()),
    "is_zk": (("groth16", "plonk", "snark", "verifyproof"), ()),
    "is_rollup": (("rollup", "sequencer", "stateroot"), ()),
    "is_factory": (("create2", "clones.clone", "new "), ("deploy",)),
    "is_commit_reveal": ((), ("commit", "reveal")),
    "has_reentrancy_guard": (("nonreentrant", "reentrancyguard"), ()),
    "has_access_control": (("onlyowner", "accesscontrol", "onlyrole", "hasrole("), ()),
    "has_pause": (("whennotpaused", "pausable", "_pause("), ()),
    "has_safe_erc20": (("safeerc20", "safetransfer("), ()),
    "has_permit": (("permit(", "domain_separator"), ()),
    "has_slippage_protection": (("amountoutmin", "minamountout", "maxslippage"), ()),
    "has_deadline": (("deadline",), ()),
    "has_staleness_check": (("updatedat", "answeredinround", "heartbeat", "staleness"), ()),
    "has_nonces": (("nonces[", "_usenonce", "usednonces"), ()),
    "has_chain_id": (("block.chainid", "chainid()"), ()),
    "uses_assembly": (("assembly {", 'assembly ("'), ()),
    "uses_transient_storage": (("tstore(", "tload(", " transient "), ()),
    "uses_selfdestruct": (("selfdestruct(", "suicide("), ()),
    "uses_tx_origin": (("tx.origin",), ()),
}


def trait(text: Column, name: str) -> Column:
    any_of, all_of = TRAITS[name]
    low = F.lower(text)
    return (contains_any(low, list(any_of)) if any_of else F.lit(True)) & contains_all(low, list(all_of))


def with_traits(contracts: DataFrame, text: str = "text") -> DataFrame:
    return contracts.select("*", *(trait(F.col(text), name).alias(name) for name in TRAITS))
