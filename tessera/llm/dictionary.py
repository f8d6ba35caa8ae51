"""Words in the order of how common they are: the tokens of the byte-level BPE vocabulary that begin with a space and have four ASCII letters or more."""

WORDS = """
that with from have this will they their more said your cont which about were comp would other been like them there year some when than over also part
time what just into people work only after play could first comm back under most again know need cons want even these because make then every supp
look where years diff should right through very includ being does down many call before well much those such long think prov show pres inst good start
made last stud count point used same differe while game inter report produ still here world though trans take conf going americ spec hand between
against high help requ found person great sign somet follow find team system lead around govern cour read real support really fact both serv three
exper each grou says during happ char gener offic public prog power different state head poss stat expl another child since life develop pass turn
resp second disc something comple month government without dist quest prot never level things might effect contro cent allow belie incre feel result
contin using best number must direct open post come seem week place form told trump stand next little commun mark information invest hard import appro
test rest full care case less partic list home left better data attack proble build main including interest keep class small rece polit plan percent
camp didn process program name four return called move group current always women near free design change chang book kill away able country const
order million oper thing school days prof health already charact friend least prom hist tell talk until later view word cost enough give united techn
large important doesn business clear rese american expect kind mean past organ perform story season claim came within line project control money
family making police happen vers sure appear light water times grow company example conc fore actually ever major often human available record sing
news econom following hour desc become took having product means certain deal side reason elect official possible hold city sever children once activ
night john done working body whether author proper seen cond course event intern short orig press doing protect thought question several given fund
went polic meet creat states games understand makes love complete account ident others prob young along according members among employ invol likely
russ rele president access euro known early fight sent today market based strong problem death social campaign months viol five stre players success
present sugg particular suggest christ priv crit land local mult political asked former close pract york getting across comb believe toget together
individual face value area writ anything experience mind future video investig impro connect redu above europe amount either milit anal fail special
black looking fire almost study miss community media food comes university single half republic started quick issue else consider taken true trad mess
added similar character house reported type however targ entire history live trying discuss self room fall idea sound someone object player rather
service nothing provide party exist behind applic function front series points below specific previous pret custom court repl whole treat probably
learn version check benef deter super address vict meas field signific feat common begin bring action describ indust wanted attempt shall step himself
dest stop hours create further america north national taking research break space recent general period everything phys saying cult coun include
position canad pick compl matter compet cannot init relations ground security concern white seems announ stri watch wind itself mass pack outside anim
pain manag sept foot third evidence threat decl item represent significant simply longer file ener upon themselves coming quite difficult woman necess
text require military review respons subject instead issues minutes weap code higher page students method policy exec accept words final changes
democr friends respect compan damage total needs agre development results obama rights brit running wasn port rate pretty target circ works everyone
block walk aust south shows site risk chall began size decision larg continue parent easy drug sense energy associ girl request soon host material
moment answ especially norm services role cred clinton office charg track heart ball personal building increase needed lost became groups wrote prop
dead http webs inside wrong statement film music share release forward stay comput original card cand favor cases section leave washington required
king countries german questions prim cell shoot anyone west affect online israel september ability content reve laun indic force sold soft companies
article educ playing held released federal administ interview install received source serious created cause immedi defin department late speak legal
weeks model pred exact takes regard opportun price problems leaders deep pers contract relationship base consum potential langu relig link lower june
contact mother estab march china provided average exam perfect shot collect phot played surpr officials simple industry hands pull round user range
private ways mich except terms dragon performance bill environment worth pict chance speed alleg japan match stru living struct separ response enjoy
member tool offer turned july recently star cong blood hope comment arri particip gave select killed goes coll impact august felt expected image
prevent involved eyes quickly behav candid earlier focus popular sett various levels road heard users improve father search profess knew loss events
billion cover bott areas twitter gets google vote nearly included recogn happened whose civil suff syri respond features economic april technology
option purch recomm training effects fast occur website email sens influ currently goal scient conv decided travel mention election phone looks
situation quality table staff tried addition lack wide board anti slow path worked engine looked victim property introdu execut color network date
extra wond reports austral capital command allowed prep capt numbers fair reach broad couple screen lives prior congress approach emer built repe
rules financial considered brought products visit document conduct completely calif written draw published secret facebook sexual thous standard fell
foreign friday regular increased usually demon dark additional production international race mach huge town attention terror meeting park arrest fear
extreme workers directly population october january david cross message nation poll answer carry russia hear natural trade subst multiple afric fans
sort global achie language necessary details sund medical monday hill receive morning bank device center safe canada systems assist surv battle paper
growth cast plans parts wall movement practice display sometimes paul avoid towards kore talking correct spent term wants doub forces please november
ones immediately russian parents americans shown conditions stuff includes experien announced republican determin described county door changed neigh
clean december european club tuesday paid attacks characters alone director load rout california finally contr exactly islam nature career latest
convers weight note teams green hundred streng consist regul costs independ normal obvious ready implement song interesting giving sunday middle
remember yourself demand treatment danger british physical related remain couldn refer citiz street stra easily clos uses write leader reading autom
legisl gold designed beaut appears strugg choice particularly london allows difference wednesday although relative application aren myself imag dise
society frequ english poor writing seven starting print crim gives cool thinking save limited meaning jack nice eight feet effort opin brain thursday
wouldn touch studies computer investigation increasing store comments doll liber wife laws modern administration opportunity powerful claims earth
title beyond camer sell appl violence east compared options throughout files james detail piece named education drive items student throw scene
complex prec concept status died knowledge beginning certainly guys slight fine perhaps income https majority greater feed safety unique gone showed
histor counter leading send donald defense muslim continued provides prison happy economy trust weapons analysis science figure disapp software
officers remains india psych observ stage enter passed despite movie voice toward region values mount officer hous pressure books sand reasons
activity senate calls letter choose types platform quarter maybe moving patients truth charge cele rock credit moved names straight feature rule sche
michael click angel iraq saturday aware pattern grad associated style stories individuals summer arch texas fully mill followed indian february jobs
seemed reality lines measure brother growing estim mechan windows rates positive culture william mart altern coach kids journal corpor false sleep
contain rich chinese meant notice favorite condition purpose organization challeng manufact susp critic mist larger advant resear actions kept
benefits actual vehicle chief efforts league wait adult overall speech highly female error effective encour failed conserv programs trou ahead crime
location iran behavior rare caused ship active contribut acqu reflect firm birth clearly emot agency memory biggest basic band suspect spread rober
demonstr absolute places impl cards destroy virt appeared temper length blog integ resources spot forced thousands minister qual french generally
drink thus appropri whom college ensure apparent religious minor primary developed peace skin blue families apply inform smith limit resist conflic
liter hair eventually helped apple prem sales seconds strength feeling tour knows exerc somew spokes ideas regist propos launch bottom script whatever
mode agree sources initial restrict wonder burn reached categ cook promot male climate alleged images schools drop stream previously double default
rank council weapon stock analy picture century citizens onto expand hero wild update customers criminal christian leaving otherwise basis recommend
floor crowd central dream download confir thom window happens unit tend becomes fighting predict heavy spend adop football transfer therefore mission
noted assum disease edit progress brown adding raised tick seeing agreement server debate supposed largest successful democratic jump syria owners
offers shooting effic haven defend beat records scen employees devices commer benefit illeg surface harm alex shut lose challenge station intelligence
accur flor requires hospital spirit offered produce creating cris ended daily voters smart lord internet circum extremely opinion gain useful budget
comfort background episode enemy trial establish continues showing union posted rise germany signed vill grand england projects conference responsible
arab learned george returned australia brief brand highest train commission incident nuclear micro charges adjust prices draft runs candidate
management phil teach understanding separate instance unless operations faith church config activities traditional direction machine surround push
easier argument spending theory calling influence commit photo disp wish revealed enforce committee chem miles interested solution removed compar
plant achieve advantage slightly placed mostly negative setting produced connection driver executive assault born structure reduce decades join disco
assess goals senior parties learning camera skills celebr franc existing willing critical serve cold species animals older teacher prefer thread matt
manager professional notes fresh doubt opened guess sequ explain attract string context republicans solid cities asking random florida depend scott
mentioned claimed definitely core opening believed holding brow authorities score cells transl neighbor remove district worse concerns presidential
policies hall independent justice protection sudden strategy girls missing politics spell graph labor kick itunes steps smaller roll researchers
closed transport lawy chicago aspect none marriage elements dram hearing supported testing massive stick guard border copy owner digital task incred
france breat issued western detect partners shared cancer explained heat investment wood tools belief crisis operation contains express finding
funding established degree dangerous freedom catch presence authority button consequ valid weak starts reference collection beautiful tells waiting
providing democrats daughter master purposes japanese equal turns documents watching reject korea victims witness reform occup caught traffic models
served batter secretary agreed truly units mike variety amazing confirmed entirely purchase element cash determine cars views drugs covered mere multi
unlike stopped johnson skill becoming appropriate weekend sites animal scale charged instruct methods cert judge dollars standing debt driving edition
album commercial discovered output hillary carol abuse switch annual stated residents allowing factors fuck occurred injury insurance repeated arms
construction forms mental equipment fant discussion regarding chair proceed murder supply input wealth proced institute putting located princ clot
telling proposed funds baby spoke earn exchange pair arrested killing identified mobile thanks hundreds chris trend electric restaur trig nine bomb
coverage appeal robert finished flow deliver calcul photos pieces appre rough partner concerned suggested herself corner husband balance sounds
millions radio satisf combat gree fuel distance tests decre managed measures attend jose generation advoc conversation frank gender concent carried
virgin arrived failure minimum worst keeping intended illegal subsc determined trip raise feels package symb farm reduced clin mary novel capacity
impossible plays fram communities strateg interests conflict requirements operating committed relatively afford identity decisions accused victory
seek tight initi humans familiar audience internal sides conclud appoint enforcement association circumst canadian joined differences protest twice
glass army expression decide planning handle microsoft maximum eval helps bound mouth standards clim ukrain jones planet winning faster spect broken
defined healthy competition island announce client possibly finish crew reserv editor hate sale controvers pages numer opposition refuge flight apart
africa applications palest upgr shape speaking worry britain introduced diet functions jeff stress accounts guarant honest tree african bush exercise
scientists legislation survey maintain leadership islamic magic prime figures absolutely fourth presented alcohol grab vari quant plus alternative
approx objects android significantly acknow mont negoti television jewish motor appearance sitting strike fold louis belong mort prepared indeed rent
advice changing listed launched peter lived supreme sets philos applied housing sust powers remaining causes manner suggests ends termin angeles
scientific coal thomas minute leaves completed focused monitor vehicles affected construct follows homes elim largely votes businesses foundation
yards materials guide closer sports taxes decade dropped delay secure treated filed column consult entry marijuana apparently increases specifically
tele religion frame helping edge organizations bigger boost stret vision wearing appreci award factor territ param enemies accident martin hell forg
veter medic stars expensive acad lock format soldiers agent responsibility rapid tough jesus believes wear warm hasn univers patient mexico sanders
happening bought soul harry seat revolution ring offensive returns videos discl famous river candidates percentage visual thank trouble prove
connected possibility expert library fellow signs quiet pure filled unable vast identify carolina prote fish circumstances bodies developing
experienced substant domestic combined chemical pool hurt markets conservative supporters agencies temperature conducted pulled advance license
imagine fixed incor surprise craft dial relevant entered leads pictures paying updates greatest height heav listen capable perspect offering bright
suppl virginia planned sweet typically francisco prospect teen sched lots newsp forget ryan severe suit correspond explos flag prin deploy thoughts
matters adapt fill forth payment spring losing bringing distribution israeli combination plenty perman seeking examples classes beer moves panel
properly plug estimated defensive pregn instit volume positions links transform opponent tweet shop talks plants attorney begins myster environmental
storage marg metal ordered remained loved prompt updated experts walking ancient performed neither manufacture selected mine ultimately explan label
meat giant wars interpret evening evil boston bitcoin amazon obviously advanced weather symbol sole potentially originally deck stood youth bern
basically involve aircraft confirm messages richard prohib vulner existence turning desire flat ment neighborhood lake pointed innov professor
expressed session bare diss cath doctor charl writer oblig recorded broke orders motion immigration contrast batt excellent technical cloud creation
strange auth fort extent rain sample accepted tact fired stands boot statements versions selling weren experiment retail depart bond reaction syrian
resolution react approved replace tack sport chain emergency palestin automatically route banks paris grew coord subs corporate selection slowly egypt
colle attempts findings index shock dynam cart storm essential reasonable subsequ considering married illust numerous seriously referred consistent
facts accompl revenue passing gather optim unknown opportunities browser reporting suddenly surprising somewhat challenges settings experiences cann
receiving joint cultural bull facing boss instr increasingly shift streets williams laugh adults customer obtained supporting detailed picked wire
sight developers persons warning boys bird observed zone channel refused spokesman sher acts struggle discrim category realize employee afghan guns
steve thick fairly surve troops agents battery motiv confident empty phen sector excited remote destroyed moral dress shouldn sympt toronto carbon
installed violent solar practices ride penn improved audio behavi eating properties anywhere blow jackson proud plane square proof talked sister holds
resident resistance split prosecut confidence cuts exception zero copyright totally australian sick household fees drivers necessarily regulations
perspective escape surprised emphas champions narr heads causing targets afternoon adds usual withd articles injured manage explains diagn linked
discussed explo occasion opposite faces denied knight approximately disappoint voting institutions drag nearby guilty conver reward philosoph apps
upper advert snow frust ourselves dismiss cere signal crimes saud sufficient historical succeed tradition description widely wave definition jews
cycle refere brings alive frequently intention privacy christmas rail cooper tested comfortable delivered depth writes assets transition artist
components walked root participants noticed resc importance assert injuries registered intent missed sentence assistance database buildings classic
thinks ohio effectively facility bear chapter dogs columb latter admitted georg posts lawyer equival mand controlled andrew menu protected administr
rein amounts native moon represents abandon carrying tank declared punish universe infrastructure opposed hardware coffee owned describe portion
atmosp governments depending offense trick desk valley movies remark mail conscious ruling replaced renew shots armed constant taste realized buff
efficient communication flood consequences anyway iron evolution relationships proposal collabor knowing supports controls merely athlet fashion gift
kinds korean legit essentially therap suffered promise excess overw houston stores olymp journey requests consumers tiny isol crash emotional goods
elected moder linux blocks elections broadcast cheap nations seasons waste fields profile authors deaths vacc formed ongoing muslims assume ukraine
coast voted michigan flex welcome locations buying architect harder interface restaurant discover exceed favour duty pitch responded extended medium
magazine limits gall external younger remind immediate hidden volunte simpl phase plot exposure expansion pushed marketing hits scot stim iphone
narrow getty turkey perfectly enable precise regime shif compens chosen trees recommended kenn arguments exists bike breaking crazy virtual permission
consumer closely hopes array labour spons readers employment creature resulting accurate moments argued sought suffering icon bonus acting comparison
smooth joseph sending dealing attached sees typical finds asia emails highlight confront unus topic adam understood dedicated songs tech rape aside
grant argue containing schedule liberal publicly heavily everybody swed femin facilities conven division stan explore shares ideal plastic distinct
seattle trading exhib initially thousand paragraph roughly creative consumption films obtain tall acknowled grown suicide watched surrounding flying
java serving jail literally exposed lies earned specified degrees centre sharing winter fewer somewhere attacked domain stronger penalty declined neck
fraud currency rising talent village legs acid involving yesterday terrorist synt saudi visible struck awesome drawn answers threats defeat vent holy
youtube situations saved recip faced elig mistake bell symptoms domin falling ending matches explanation anymore letters risks reportedly plate
subjects attempted unlikely colorado veget shel marked defe theme passion info shit poly component charles ireland doctors granted paint honor smoke
payments primarily kingdom deals scheduled fundamental protein newspaper clients feedback stretch cock hotel queen sugar milk approval equivalent
insert extension accomp constantly generated recognize vary soviet patterns profession colors infect phenomen shell puts delivery processing lights
brook industrial brazil somehow proport politicians indicate hole techniques competitive campus aspects helpful shield trigger tort personally keeps
bench recovery profit colon strongly allegations reporters flash strict parking pakistan weird eric regions intellect finger elev conclusion feelings
extensive mixed neuro harass territory successfully ingred overwhel layer allies bunch normally networks sacr chose opponents regardless franch pref
bridge silver wage radical manip gang decent uncle investors walls publish generate promote cutting chest drinking collected hoping embr warned
instructions gear criticism util counsel asian reduction teaching deeply estimates choices permanent fasc tournament contained holly wake reveal
processes isis blind steel carefully gaming houses truck scored occas sharp afraid scheme decline pushing possession privile teachers yield davis
daniel hide colleagues principles loud stone taught terrible stuck implementation wheel repeatedly likes catholic bath noise northern magn displ
ticket murd alongside georgia cable wins upcoming survive inspired statistics yellow urban quarterback register abilities variable contem thin gotten
constit asks tail exciting spanish encourage commitment rally subsid spin captured innoc allegedly artists electronic regional myth miller directed
extract sorry vice wonderful ships kevin activists arizona habit inqu abortion void explicit engaged angry rating frag worried obser apartment estate
constitution disag stephen immigrants folks targeted stead informed driven regularly basket principle stun roman alert democracy represented diplom
capture announcement lear hook purs refugees recognized hadn pilot returning trail routine courts desper friendly italy pled breath studio impressive
afghanistan fing downt fault nick rose southern outcome elsewhere retire pounds communications loan ratio empire gonna invent promised dinner creates
operate jordan sustain incredible warrant lawsuit reviews ford featured forever poverty laid filter creatures royal brad valuable taylor liquid carl
wilson incredibly solutions atmosphere blame putin respectively fifth governor purchased hack intense origin define careful shoulder tied destruction
nobody technique legend accord busy intel hang surgery reprodu uniform scenes crypt recon scream adopted scores italian indicated entertain twenty
engage pacific smile personnel toler doors tone machines entering jersey forest horse complaint academic fruit wine pursu steven licens clothes squad
stable keys complicated absor funny relief chart drawing module salt resource somebody participate muscle consent continuing guardian rear provision
liked meetings convent auto recording programming proved stab caption newly discipl greek passes guest acceler authent armor compat inches assign
prepare depends tracks lists alter eastern condem everywhere affili fought scope enjoyed aggressive recipe rarely subsection frequency behalf sequence
controversial comprom worker mainly algorith organized fake concluded chances configuration withdraw brian tries samples golden photograph parliament
contest signing zeal exit racial reuters sword romney trib inner protocol miami shipping amendment howard princess anth surveillance apolog fulf luck
anticip winner unusual crack ties practical province priority describes branch porn turk enthus fighters detroit judgment solve neutral palestinian
hollywood advis reputation smell bread beach claiming genetic technologies upgrade developer josh disney unex barely illness patch butt stupid dallas
protests chat wing render greg recover incorpor preced threatened spiritual fred advertising improvements errors sensitive navy cream exclusive
comprehens deleg conce remem structures stored budd academy temporary tickets possess contracts mountain captain spain equally lands rejected
transaction henry provisions gained directory raising console uncertain measured plain seats dict estimate contributed episodes terrorism movements
prev suffer nerv mainstream wolf franchise demands agenda dozen clinical visited actor delic contribute inject listening premium irish assigned
worldwide narrative bowl relation covers certific grass engineering mars unemploy steal replied ultimate titles hyper officially difficulty resulted
viet barack restrictions beauty maps cruz electricity burd violation usage permit chron naturally thrown awoken alien kent rick pace poison tower
formal genuine procedure trained crucial lets champion writers connections okay rand encounter achieved checks assistant whenever clock borrow
personality gains commonly terr hypot rely tiss ridic oregon uncom vulnerable tony occurs vessel scotland discrimination subsequent fantasy shadow
testim boat marks ordinary representative petition adventure ignore philadelphia factory tasks depression cogn eligible reducing striking dollar
instrument philosophy moore avenue ruled scenario nasa enorm debut absence tables chairman pump rapidly substantial santa saving minnesota recru
assessment bron dynamic furn propag accommod stack reven godd zealand brut perpet hardly transactions gate screens submitted languages falls strikes
deliber relax senator extrem disorder locked emissions shortly rival dust reaching jason satell stations agric unfortunately applies anger compare
aimed regulation jury airport sections prince medicine hitting spark foods replacement chicken lowest minds involves arrang procedures bills
improvement inev expectations intellectual spaces mechanism tenn balt barrel static tips handling journalists comic nomine versus loop surf hunter
beliefs setup brew computers medal taxp displayed grav fiscal moscow kong cameras aver kelly requirement entitled elite divided heading copies losses
steam reporter superior therapy peak lying responses consideration bible loyal instant extend convicted founder convin scholars overse latin substance
minority manufacturing attended appreciate guarantee ocean headed tape loose logic proven spir admit investigate requested behaviour reader hung roles
implemented blank serves cited repair critics shout fool producing rounds circle prepar submit vital password publication prominent speaks bars deeper
butter smoking indicates presum polls secondary monster ownership arrive null thro kiss upset galaxy corruption hint greatly begun soil anton
maintenance dozens humanity alabama gathered attacking arbit wisconsin dance saint baseball contributions literature exha container fallen websites
bottle breast veteran interviews banned concerning expenses matthew columbia entity reliable paralle christians opinions indu compete thorough
employed establishment lawyers lind efficiency mask disaster ages casual enabled emerged cabin registration fingers roster framework transportation
awareness attempting defence scan atlanta fucking answered categories rational cust robot correctly graphics grounds distributed sanctions challenging
ingredients invited founded brothers wages seed addresses iowa attitude mole discovery supplies distingu recept vert swim yeah interact convinced
objective dish downtown tomorrow survival settlement xbox ethnic incent maintained breaks recognition welf addressed kansas virus whereas papers
ministry pleasure acquired duration calm burning folder illinois goddess performing welfare enhance notion cannabis diego manchester covering citizen
phones raid ignored upload modified rooms suggesting clothing austin heaven stages wedd phrase brill providers silence platforms demonstrated interf
races grade flavor historic colour viewed intervention diversity periods reverse quote screw landing pill protesters repeat salary pennsylvania mayor
kitchen featuring museum servers anybody finance closing patri firms embarrass letting threw channels vegas sear fantastic swing sheet variables
spoken loaded footage phoenix throwing firing tracking width struggling monthly eggs hired stayed allen stro turkish fabric dates pron basketball
lucky arabia assumed affairs glad joining populations nose complaints scoring mining visitors damaged characteristics pent flags execution joke
testimony obst studied nintendo kernel overwhelming aged applicable roads commands offices receiver shopping entertainment reads employer involvement
anxiety roof democrat stats constitutional referring tackle backed hong defeated seemingly jenn kurd gene discount clubs marsh beings introduction
meal bang ranks collapse opens echo soph racist enormous waves comprehensive farmers proportion designs negotiations virtually batman warn legitimate
convention consistently compensation punishment bureau philipp knife memories ross angle thunder rend counts educational accessible drew trials
preferred signature retired bytes neighb devast suspected capabilities revel cheese failing heroes ghost appointed institution expanded monitoring
podcast coalition stolen stops holiday intr lgbt warming anderson producer accuracy marvel patrick mini overt membership exch removal dave adequ teeth
emotion perm solely extraord guidelines dying suspended premier anthony abandoned horror childhood campaigns lunch albert bone tonight formation compe
discussions criteria installation accomplish publisher rescue pocket bene assembly parameters alexander concert shoes visiting recall rural concrete
loans trem harris fate tired principal sevent mood strategic diseases forum tempor headquarters guitar releases disabled unexpected unclear contrad
strategies passage improving reveals decrease annoy cyber photograp diverse encouraged conspiracy birds operator handful classified dramatic
investigators widespread collective journalist temperatures guid inspect missile manual simultane ratings suck universal pharm disrupt statist walker
undert deny provider surviv mistakes node massachusetts fails shirt waters ease scar contents contribution handed stability trave mirror weigh fiction
physically stake lewis demonstrate profits battles drives sony lawmakers protecting shame attach representing utah incidents viewers mouse clar
accordance innocent initiative spots conventional corporations blocked refers buck topics underlying investigating pregnancy touchdown caller
instances fears remarks experiments judges stere participation jere weekly conversations pitt indiana infection settled strip dump references wanting
exclus gentle alliance lift cleveland ranked stadium deadly riding documentation greece lens gross arrival desert supplement knee margin intake
differently bits searching functional baltimore desired circuit minim drove pros utility concentration font amid revers interaction jurisd spells
civilians entrance convert controversy contrary packages progressive reserved samsung printed centers introduce kennedy odds surely independence
passengers loves espn facilit identical doct partnership confused wrest iraqi holes pregnant signals pulling graduate nominee permitted oklahoma
authorized alarm generations edward controller approached cance formula weakness ramp brilliant accus homeless organic presentation bernie tong rush
marx calculated devil sarah occasionally bullet hosp promises corporation accum terrorists consciousness drama utter assass gest abroad metab sorts
flav musical drops equality burden ceremony fighter actors align elder representation ontario harassment symp boxes manifest dies missions resolve
followers silent timing prisoners kings approaches precisely keyboard funded staying psychological mile leon barb wider atlantic till rome accompan
flour pleased pointing inflation wedding requiring qualified segment sizes corrupt celeb dreams checking preparing actively deputy transgender summary
inher knock impression celebrate slide guests clip savings legacy denver wounded pursue semi obsc checked dual elizabeth centuries evident
unemployment mario intim biological soldier math bias dating mice meters rocket certificate iranian grid rolling sweden tissue racism mystery examine
stem sits hoped dialogue persu chronic portland parallel scandal carries phenomenon retirement duties dose scroll sauce landscape championship reddit
coin overs posting bold focusing deemed recommendations stepped voter instagram moderate maryland restricted collaps ought export drunk wise ancest
frequent interpretation dependent coins justin fatal cooking confusion custody morgan restaurants acknowledged ther genes tactics mexican vend noting
cameron targeting credits emotions representatives legislative removing tweeted carter forcing speaker males vietnam concepts voices jerusalem sant
lady hawai arts emperor slot athletes temple presc tons punch enact lobby picking lifetime cognitive consists festival intellig dele lapt magical ruby
imposed astron correl immune courses lean outcomes expense everyday acceptable equipped orange dutch roberts disappear spawn deserve minimal nervous
rook vancouver resign affordable gary arena hanging implications maintaining guards derived executed theories quoted andre belg tears birthday
spectrum architecture recruit monsters destination attractive foss moreover presents reply delight affects donations overcome beast investigations
hunting sessions portray communicate comedy yang belt marine predicted importantly remarkable eliminate bind advocates gaza charity caps fleet recre
sleeping designated animation delayed tremend curious lect innovation loading dispute nurs template appearances translation sake beneath inhib
studying perceived examined eager coaches imper produces municip girlfriend hire suitable inequ duke interior bruce analys considerable forecast fert
ballot instantly picks tent civilian inch logo cooperation walks investments imprison legally threatening dismissed harvard roots discussing continu
refuse managing synd professionals guidance universities assemb anniversary transit restore explaining asset transferred burst meets corresponding
insisted surrounded tens lane coinc existed skept perception adopt satellite infant meanwhile tobacco flesh beating gathering cultiv jonathan badly
choosing contacted quit distur stir token functionality limitations meth veterans trends wondering clark separated desp relating enthusi activist
explosion insight convenient counterpart tennessee simon overseas pride displays traveling hospitals defendant streaming berlin distribut antib
chocolate castle interrupt conversion bugs jean dean gameplay warren highlights irre nato balls demanding luke awarded regulatory hart sour pixel
automatic khan extraordinary python sexually desktop antonio orient ears manufacturers conviction garden satisfied inhab programme stomach coordin
threshold rhet serial employers bother brands pink furthermore landed producers healthcare dominant destro amended fits fights corp toxic corn chel
telephone pant mysterious witnesses questioned brexit endorse ridiculous prayer scientist underground subscrib hosts grants summon suspension
guaranteed rice sean shin referendum fled shocked allah partly ignor transmission homosexual hopefully lesson boards incorrect bacteria snap parad
availability wisdom priest span parameter convince safely converted olympic reserve healing inherent graham integrated pipeline applying embed charlie
cave consensus rewards html popularity electron integrity exclusively grace torture burned entreprene administrative manufacturer isolated backup
promoting commander flee russell forgotten missouri residence resemb wand meaningful helic wealthy rifle expanding hamilton receives briefly stimul
chip prize associate mild propaganda anonymous struggled outrage beijing leather worlds broader tear proposals iter volunt speakers borders figured
simultaneously charging urged conj gordon documentary thompson tanks lessons outstanding volunteers spray managers camps artificial bags compatible
blade argues unfair offset directions disappointed viewing towns layers rolled jumped attribute unnecess suppose nether buried sixth wound cycl
mechanisms congressional agreements decor closest mixture fluid scholar pist racing cheaper vertical helicop sacrifice violations anna beck dick
composition texture smartphone forb defending jeremy banking respective drinks bands liverpool grip openly reviewed verify cole wales unpre shelter
imperial suggestions explicitly slave blockchain competing promising soccer distract tokyo accompanied identification invasion industries subtle
survived flaw holl deficit tutorial arguing contemporary integration hiding spokesperson emerging preparation prost suspects autonom dealt pear steady
decreased sovere gradually dirty barn calendar compliance chamber passenger sydney darkness defect packed gods harsh algorithm oxygen visits kilomet
kentucky killer divine nomination engines cats buffer phill traff tongue radiation couples physics politically bloom worship mathemat sentenced disk
optional babies seeds scottish hitler recovered powder lips designer disorders courage chaos carrier routes engaging javascript unions federation
tesla completion privilege neur bones titled prosecutors engineer hearts penet bulk marketable preval poster attending licensed tradable blast titan
flame profound participating anime specify regarded sons merc experimental dungeon comply seized constructed hosted scared islands bless blocking
chips evac lighting neighbors beef uber occupied aims additionally dramatically heal painting engineers quantity earnings stance dropping dressed
justify prompted scrut speeds giants describing nowhere instruction entities inquiry pressed raises netflix outer amongst climb combine compr
significance remembered nevada warriors jane coup terminal tension wings naked gulf density dimin desperate presidency unlock handled disappeared
genre determination acknowledge capitalism painful curve bombs aaron inspiration exhaust descript ritual chelsea promotion ward toss francis happiness
beta strengthen buttons murray kicked drone preventing retro cruel float filing styles cake builds epic stew outs solo preserve wright bund traged
occasional interactions owns hockey logical expend escal griff crown stopping excuse operated reaches malays pollution brooklyn delete hash shorter
horm prohibited intensity alan liability neighbour fires revolutionary orleans dawn settle execute spokeswoman lifestyle clicking nazi trailer
mountains damn pressing bail thirty electrical demanded backing mothers variation grave interviewed rookie depos ampl peaceful diver victoria stating
lung criticized vaccine fran robin detected adjusted opposing conflicts argent matching trek engagement executives liberty talented consecut horrible
surprisingly females oakland mechanical robust theoret retain deployed andy subscribe michel partially comey documented brutal theft tube query
lincoln publishing wore notable subsequently observe codes residential sophistic cens mortality yours occasions recalled vocal bathroom shops
collaboration obamacare tends torn economics shoulders expecting examination midfield layout floating tremendous abund lightning similarly
conservatives pray tempt emphasis metro fishing marry reck dispos suspic merch yemen environments reflects honey analyst households ster reforms
favourite deadline nights invalid delhi wireless hostile ally outlets abstract adviser bases courtesy crossing cleared refugee throws disagree
reflected singapore raven embrace chen appointment placing bicy whis investigated photographs evolved encouraging prosecution pants fossil rocks greet
filling diabetes firearms accepting resort hunt sustained crossed breakfast attributes vibr touched damages impressed anch adams victor mounted
delicious elabor defic constitu indones confirmation spider processor pentagon robinson realistic appearing pipe awful evaluation intelligent fundra
tweets worn kidn rebels netherlands acquisition tradem adverse organisation harper scratch sensor adoption honestly yard patent bass quietly breathing
pose jess preview horn reass peer unto gray cleaning attracted horr mississ worthy flowers reactions dece indicating preference indians misc freely
muscles lineup impacts controlling ranking nich highway incons binding struggles pittsburgh comics relatives fright probe portug corps possibilities
qualify libraries migrants entries consecutive gard inequality cort traits pour missiles essence sends wishes christopher jacob advocate districts
reagan influenced challenged barg faculty acquire insect instruments leaf tale thereby trap strongest flexible kills finishing reduces epid
orientation trace laser oppose editing momentum murdered probability reluct montreal adequate poland sheriff operators modes discipline oral
palestinians hence overl intimid ranging distant wrapped chemicals frozen indirect uncomfortable gallery consequence bitter countless alaska departure
refund seeks mechanics jurisdiction alike resolved cache distinction encount continuous modest criminals indication encountered ideology jimmy hiring
crystal penalties capability productive balanced geforce afterwards playoffs gill backs absurd citing trillion obligation maxim alpha nelson pursuant
fract thor awkward wallet releasing edited accomplished edges planes feeding disclosure grain reasonably drum partial graphic unprecedented advised
assad hamp fixes caution strings panels leak pricing saints observations suggestion ukrainian barrier painted compound bears luxury orbit marc exempt
hans jerry bust wiki endless vlad radeon commod revenues furniture casting diplomatic modify innovative bonds coaching modules patriots enhanced
proceedings teammates compromise flew unnecessary doctrine orlando playoff complain beaten golf placement newsletter ipad acted juice decks deleted
secrets asylum assuming mana subur difficulties collecting bankrupt composed volt militants mormon particles bart admin squee creator grabbed nodd
rated rotation grasp excessive whit inventory ecosystem billions venture defender assumption bite earthqu gifts inevitable structural beneficial
compelling coat determining rhetoric boundaries whites harvest laptop enjoying trips addiction powered cous russians retrie differ laur capitol
conclusions transparent infer intrig insane pope reset aggreg carb decides exceptions commissioner legendary tunnel insult troll shake detention
chrome subt prospects prol performances href achievement leban projected colleg awards blake pending instinct developments philippines altogether
oldest detection wayne circles donors dakota motivated purchases louisiana globe departments sustainable prevented incomp dominated invested
complexity incl ensuring realm athe speculation plaint plates devoted slaves pepper quotes ceiling transformation fraction advantages toile stunning
moist texts ugly trains temporarily overnight mamm treasury venezuel mega expects acceptance radar junior frames observation sentences analysts vague
clause directors evaluate cabinet cler researcher poorly experiencing manhattan freed themes praise libya trusted cease dign bombing migration
sciences municipal glory revealing uncertainty battlefield cinem listing waited spotted lone transf wash slavery exploring encl creek wooden arthur
bureaucr blend supposedly winds gravity analyses dumb alternate consumed effectiveness paths enables escaped smiled tendency pars fitness hier impose
pension polar exercises diamond harmful printing expertise tragedy divid reign unve amend prophet mutual replacing throat batteries toll addressing
medicaid pupp equity hispan exped demo marshall fiber divorce slower parker panic quarters rect treating rats christianity sacred declare delivering
larry meta roger header trapped knocked oxford survivors demonstration dirt assists judicial secured hosting lifted wheels diagnosis stewart
nationwide dear obligations grows mandatory suspicious mortgage prosecutor editorial processed flexibility focuses startup breach bizarre vegetables
retreat hawaii productivity absent identifying regret promoted inbox horizont branches metaph mods spirits earning riders sacrific occupation disg
nodes pier hatred theater sophisticated defended besides thoroughly medicare blamed crying singing cute donation eagles substantially grey keen
conclude mississippi studios rangers seal weaken commons cultures laughed slip treatments obesity laure elderly pays complained crop proc explosive
arsenal meals imagination annually boyfriend bump surge craig kirk scenarios competitors stanford organis separately habits measurements accompany
tang plugin convey curs approaching arrangement affecting permits useless destroying fascinating electoral transparency volunteer statistical
activated hampshire trash lawrence rings operational evans witnessed launching assured binary betray exploration admission avoided simulator
celebrated cluster nash spare enterprise flights regards trucks contacts uncons immense embod patrol beside viable creep triggered comparable gaining
prosper polling shar firearm fence variations pledge cure violated rushed stroke pale collins canadians tune laboratory nons disability singer traded
warrior infring franklin strain swedish seventh benn syndrome wondered purple journalism rebel invite cheer bedroom queens dwell playstation operates
motivation predec anarch grateful excitement treasure longest deserves reserves cops ottawa egyptian artif hypothesis purchasing lovely divide
strictly questioning taxpayers rolls ports magnetic inflamm brush bottles padd devastating compiled medication twelve perry leaked unity infected
traveled mcdonald interven taiwan bearing zones wounds discretion succeeded iconic screening ministers separation beloved counting tablet offence
ninja protective cass cuba chronicle fastest germ boom stanley clever enters linear comparing purely safer potter cups gluc attributed dupl precious
robots lobb statute prevention maria thou influential forums starter citizenship accusations sensitivity summit pedest rubber agricultural cancel
inaug contam firmly tier invention translated pizza debug horses boring hood mccain bros skip essay legends ammunition shooter supplied generic
climbing flip jumping frustration terry neighborhoods median brains shaped draws altered recipes skilled behaviors declaration reson bubble feminist
kyle accounting connecting rehab meantime physician campbell brandon contributing interactive helmet shipped completing spreading scary romantic
stabil accurately acute hann symbols civilization considers venue oven peoples slee slic corners baker laughing todd hills nuts liver agrees fundament
fisher auction threads lacking celebration silly tatt singh rage rhyth phantom headlines responding vitamin boots viral stocks churches murphy denial
toug makers ronald generous morris transformed kickstarter wrap loving arrives heter rental belongs attorneys crops matched dispar buyers cambridge
ethics justified marginal respected nodded serge warner dash entert knees attitudes qualities notification anticipated barry computing connecticut
lesser peers technically submission manually respondents fare receipt agriculture skull passive societies reminded interference scrutiny witch
conducting exchanges mitchell inhabit twist wherever jokes benjamin lions highlighted arkansas pile prelim felony practically actress visa embedded
hybrid earliest sooner steep disadvant exploit ultra necessity dated masses subscription anonym presumably philip comed reflection extends forming
unders grat concentrations insulin secular whilst winners deliberately sink mandate gram vacation warnings commentary intu aest reasoning breakdown
zombie thrust technological deciding trafficking endors swift metabol enroll repeal modi underneath diagnosed shower jihad trauma consolid calories
flynn fulfill chains notably chuck hend deposit affair trop virtue satisfaction switzerland shook counties charlotte transcript redd alternatives
eleph prejud expressions shocking reds readily planets collapsed madrid irrit buzz accidentally frustrated hungry huff labels barriers berkeley jets
pairs humor magnitude aging mason friendship emerge newspapers ambitious richards cookies sculpt pursuit scripts arrangements diameter loses liqu jake
understands approve intend stays investing believing taxpayer quebec swiss drain straw screaming counted damaging ambassador prox arrests prescribed
independently fierce brave suits baseline namely melbourne arriving quantum funeral turb combo deployment invisible rendering unlocked vladimir
kurdish sounded detained daughters disturbing tast unfortunate attendance parks memorial alice shan shifted lighter pokemon prototype unre communist
tyler participated suprem vessels tribe assumptions pound crude swimming inclusion advances conservation overd buffalo madison sidew catast krist
activation unconscious satan susan arranged rumors keith avoiding guilt olympics sail columbus harvey mentally impress ubuntu superman intentions
likelihood toys watson urge occurring beng stones twin politician abol refresh arbitrary troubles pilots distribute audit pause rivals fancy crashed
tract shed consume voltage condemned excluded establishing heritage spectacular unst snowden protections macro functioning mush puzzle ethical
governing ferguson restored stressed seiz permanently neat cord severely aven interrog triple arise flower newer lair adjustment divers gamers
historically analog longtime prescription maine deity multipl reincarn recy quad glob conced capitalist blacks danny animated rendered streak clouds
doug discour psychology frost suspicion relate nvidia vulnerability isolation cooling barcelona cocaine mutation cryptoc sisters activate dread propri
outdoor sheer gently vegan crus responsibilities prevents stiff athletic columns companion packs knights fart streams shore appeals electro statue
nort inspection compassion tales stein lion withdrawal objectives bloody preliminary jacket dimensions wreck doubled glasses wang norway feared
touching arguably ncaa spat attacker eliminated destruct lucas brady blues timeline delegates shapes pione colleges rows spite assessed lease
confidential manning sealed calculate teenager mock fest switched resume puerto lanes palace variant wikipedia exceptional manages copper exports
portfolio elevated resur monetary fifty malaysia confusing praised volumes mature nonprofit passionate descend chrom dancing eleg advocacy finn
priorities thereof rogers substitute jefferson lightly lisa shifts drones workplace resid preferences debates helicopter honour considerably anne reun
hallow condemn tender turner garbage karl oliver traditions advertisement archive villages implementing dietary switching velocity financing lasted
reminder precision designers fried tragic wield initiatives joins arrow generating searches randomly batch posed pursuing testified senators johnny
taliban analyzed rubio ignoring refusing sweat dispro labeled pleasant triumph aboard incom crow folk chase brus teens terrain abused supporter tampa
newest admits ende failures infinite continent accommodate clay hammer alberta revised minorities measurement disable fork rosen implies proteins
aggression facilitate illegally academ puzz audiences noble syntax beam origins garage verdict dwar sentiment wildlife burg recommendation convenience
convinc warfare constitute abort martial incoming tolerance flows souls foul genius limiting lore adventures varied invented dive expose hacking
educated depri incentive oversight tribes belgium licensing specialist corbyn summar overlook inappropriate downloaded thumb reincarnated demonstrates
bloomberg oscar brun glucose certified relie humanitarian prayers renewable distinguish dense editors migr peters arctic cape locally lasting handy
tensions formerly ideological sensors dealers defines proceeds proxy bash sheets theatre chapters millenn dough imagined clinic holder restart hamas
disclose translate immigrant annoying treaty legion crowds aggress seam intercept dimension consistency rushing douglas trim mentions classroom
fortune unle investor masters associations provincial walter unlimited ebola revenge outright fitting formally problematic hazard encryption
straightforward loyalty lyrics welcomed cooked monop nurse misleading eternal shifting institutional incon donated exhibit tire muhammad mobility
varying vector scrap enabling socialist billy cargo farms midnight sheep sponsored charts adjacent tricks manga exagger fruits midst legislature neil
tourists nevertheless mold drafted substances breed tags verb manufactured polish determines utterly sect gates chap aluminum satisfy predomin
elaborate measuring spencer prey installing wrist kerry rachel cotton loads classical desires autism compact hurricane cycles drill colleague maker
mistaken whatsoever sells airl solved sectors horizontal equation trademark makeup assembled saves halloween vermont farming asleep referen bullets
stairs maintains acres coordinator counterparts indict chunk cents accordingly germans eyeb ranges holland plasma swap athlete rams infections corrid
patches traditionally revelation sweep glance inex lynch leverage reid correlation repository reed tactical quinn raped algorithms rodrig illum fame
introducing delays raiders whistle novels deriv publications commerce aston roth mate parade maneu cincinnati waist discont staring alias securities
toilet jedi unlaw weiss prest memo tooth subjected lineback retailers dangers voluntary interpreted careers threaten memor bradley shadows pulls
stranger backwards bernard theoretical ware flames seah defining ordering immun persistent hind photography subsidies routinely disgust assignment
fond intersection dignity cartoon scales surveys indonesia artwork unch cycling characterized affirm innings aliens cloth digest predictions aftermath
miner clarity pronounced creators earthquake laying undermin sequel reception sequences outfit delivers blown glim facial greenhouse tokens teenage
lang celt sued patience nest jennifer offseason riot defenders automated penis insist diagram garc recount appreciated doses costly grams wrestling
trophy nerve pledged playback creativity attackers holders transfers colored hindu drown listened appealing disclosed pleaded navigation photographer
rider slice erect vikings appet authentic announcing meter rogue workforce renewed organisations compounds envelop supportive brussels guild averaged
lengthy forgot dealer recession desperately hunger sticks intentionally demol debris leap containers commented woods organize axis denmark pand
outlined dare searched navigate hebrew relies catching imprisonment pockets closure recruiting argentina apologize lacks tuned griffin infamous
celebrity credibility economies headline cowboys indef lately incentives resigned profiles schemes yahoo abst wished marco sphere bishop incorporated
hated donate lined beans stealing costume forty intact adapted travelling nicely dried scal broncos intimate chemistry optimal popul analyze upgrades
cares extending freeze inability organs pretend outlet mall expressing licenses mitt filters milwaukee unfold nutrition founding undermine easiest
czech mack sexuality nixon fortun surfaces carriers interval frustrating boats abraham suited venezuela evolutionary negotiate confronted abyss
barbara belonging villain accountable portions kate magazines regulate overview scram loot fitz characteristic snake rico trait adaptation airlines
archae bikes literary influences plea pond evaluated obtaining demographic vigil spouse seahawks rises michelle potent sparked laura bryant smiling
nexus defendants catal dishes prolong calculations cancelled grin territories neglig ammo misunder carson albums pistol interpre beers firefox
spacecraft prevalence economists cant pole willingness complement scattered inmates bleeding queue melee digit lifting packaging lebanon punished juan
mapping inevitably vanilla watches leagues initiated recalls ruin melt baking colomb radius fict wizard spends neurons rall buses adjustments cried
zion meditation dennis ours rankings advers surrender multiplayer heroin optimistic indicator brig grocery applicant organizing encounters jewel
christie heating lazy cousin regener nearest achieving richmond anten narc hispanic prophe thailand injection inherit medi whoever overhead violate
heated descriptions achievements eighth specialized delta newsletters confeder abbott immunity implicit surviving rust sketch bees merit paste koch
ignorance basement foster detain neural proves invitation cattle bicycle consultant apology tiger individually brazilian disturb entrepreneurs forests
acids bald compiler donor tribal applicants salaries misconduct eaten marcus favorable stub faithful electronics vacuum tenure sincere progression
denying distress mixing colonial privately unrest premises licence samuel convincing netanyahu handles gonz hackers customs gran manuscript offenders
holidays nightmare lever exhibition enthusiasm wheat correction evangel soup implied sexy icons fathers carib regulated cohen bobby bent wallace
murders commonwealth nasty administered genuinely hydro fines gorge rope disappointing cage doubts vendors liberals contractor upside tricky
regulators rebell locals physicians behavioral brick conform reviewing insights biology committing atomic pere preserved prisoner bankruptcy gren
exploitation signatures finan musicians selecting examining artic pets impair tablets caut logs mounting unaware dynamics palestine collections
successor clone aiming possessed sticking shaking locate fifteen harrison continuously valent bypass mast protects artistic sometime shoe shouted
concentrated generator armen clearing ladies dialog inputs poses slots leaks bosses newton austria mage teaches wears curse gaps iceland pinterest
landlord definitions sufficiently pence surpass superhero priests definitive secretly jessica locker disgu flavors kicks teenagers halt gabriel fever
satur affiliate edwards retained limitation refusal butler accidents imported divisions receptor carlos malicious stepping attraction pirate charter
dining insists configure marketplace refres behave endorsed homeland rides flooding risen continually unanim guided chile succ committees luther
bennett contrace coastal stalin sponsor morph runner unbel dubbed relied celebrating lobbying incomplete restriction incap expectation apollo intens
sync manipulation spear breasts volcan formats bast parliamentary servants trudeau grim arabic prospective bored accessed taxi pete tribute empower
glenn guides dioxide gore sierra valued pointer risky absorb refuses bonuses hilar collector workout philosophical sandy liable overturn tribune
factories catches prone matrix login inacc exert needle notified reminds publishers flies emily flowing hardest modification crashes urging falcon
inhabitants terrifying utilize banner cigarettes senses holmes practition phillips compile medications fundamentally weaker garlic outbreak economist
obstacles orthodox placebo angels discharge destructive dairy collision tigers dont hydrogen variants browns indigenous trades remainder swept redist
unint vicious reversed shootings filming touchdowns grandfather affection overly sporting mercy brooks performs tightly demons killings faction nova
undoubtedly underway briefing prediction portable gand presenting justification contractors chronicles proving wives molecules fairy consisting nucle
gotta mobil verbal monument tile compatibility sadd instructed mueller lethal hormone orche skelet entertaining minimize undergo constraints cigarette
islamist travels panthers lawsuits cryst lowered aerial combinations haun vine quantities linking angela recipient socket solidarity varies pakistani
horizon provinces frankly enacted endorsement overtime beats jamie accounted packers lesbian amendments hopeful finland spotlight configured troubled
gaze calgary reliability insurg pixels handgun paras categor kinda conjunction bryan dominate nail oath erupt buyer dissent illusion boeing inadequ
rebuild destiny bangl segments systematic portal dragonbound dragged thee barrels comparisons anthrop pictured tires classification rejection ranged
safegu probable qaeda chick imports blew anytime wholes calculation upgraded appar jong dice relying profitable slaughter feather deterior stamp flaws
shade passport conting observers neglect brotherhood skeptical emotionally kicking carm athen ladder unacceptable crowded morality fuels cables
mankind caribbean anchor byte crafted historian towers helm credentials singular jesse tackles contempt afore urgent offline breathe jumps irrelevant
gloves talents palm canon verizon coupled fundraising mathematical cardinals sponsors bulls propose memorable embraced declining spam pitcher caring
airline certification empir sensation dism bolt evolve consultation touches nathan faint herm sacrament anxious socially solving reload pork discourse
tournaments costa violating interfere recreational speeches needing remembers credited cuban preceding nonsense smartphones consulting suscept feng
wholly suppress concealed happily accepts rivers mcconnell pussy attain deposits notorious shaw epidemic smallest accessories surplus mech ambig chim
practicing domains silicon kilometers smash warranty nost dublin tastes bout switches bapt sourced attachment fitted unlawful authentication stole
accountability albeit submar integer blessed legitim merkel disposal gauge induced questionable herald clarify tracked autonomous tenant qatar
resistant wells miners misses graduated synchron efficiently transmitted globally montana piss shelf testament julian spont shutdown inconsistent
subscribers skeleton nebraska inspire angles springs benchmark vaccines shine kath gesture oppression conscience incidence mineral spurs opio wasted
curric marker extensions offerings defenses vendor contradict colin peripher sins shah administrator pornography tuition catalog suite hike
reproductive drought noah dude relaxed partition participant telesc feas sweeping lenses matchup credible grandmother thermal subscribing identities
reluctant assisted pharmaceutical sonic fury mong phosph treats steadily hello relates clue revision mines blanket eagle capac ling parenthood carn
rifles guiactive tourist unveiled predecessor offshore optical pearl stared farther designing nancy mascul casualties sullivan aster hotels
considerations couch manipulate synthetic assaulted offenses drake impe blair grief opted resignation verse tomb aired assumes inferior bundle multip
illustrated tactic dressing relent scarce candy affiliated sprint garcia junk portrait disputes reyn hipp floors worries settlements mosque finals
crushed mans sovereignty seller apost amateur dorm consuming armour roose intensive eliminating sunni aleppo advise halo descent simpler booth fist
shotgun robbery obscure embassy militant incarcer generates launches administrators shaft circular freshman joel duncan bore broadly simulation
disappointment upward boundary darker dominance oracle lords scholarship vincent encourages premise holocaust rhythm metric transported ancestors
freder qualifying karen mighty explanations fixing declaring anonymity juven nord doom incomes pecul lightweight accent increment chan complaining
baghd midfielder overhaul hollow titans disproportion demonstrations crimson enrolled brett aide heels broadband marking chiefs ingredient farmer
goldman stain exploded mccarthy greens motorcycle particle cholesterol stair oxid desirable theor promotional shortage recruited infants testosterone
deduct distinctive firmware explored factions vide tattoo financially fatigue proceeding miser chairs dent disreg abnormal concess servant aspir
precip recordings proceeded colony stripped potatoes finest crap zach goth billionaire sanction logged cricket armies uncovered rebounds nationally
inserted governance privileges favorites lover gorgeous slipped veto slim denies maur distances wanna lemon literal distinguished answering religions
compos youngest altar digging pressures assassination birmingham sovereign depicted dispens ambul tibet hierarchy preseason peterson colours worrying
backers palmer contributor hearings urine zimmer strengths logging thai walt crews sharply redirect teasp intro malware breeding molecular linebacker
emma planted symbolic filmed diets concludes certainty strangers copied metres deliberate washed lance improper genesis kush realise embarrassing
verified outline zombies modifications moses naval victories nonetheless injust insufficient negotiating guarantees gambling congr presidents poured
tory organizers adul ensures massacre grades vatican backgrounds exhausted clan compromised isaac interrupted twisted dragons kremlin fertil unwilling
priorit graduates subjective issuing viewer woke depressed bracket striker portugal fleeing stretched revelations alignment jared blogs clash runtime
unwanted scam rack enlight ferr convictions piano circulation backlash wade receivers networking explorer lecture uploaded nazis portrayed buddha
oversee stealth appreciation basics clips nursing proposition realised allocated smugg fluct kits uncommon resting pursued assertion mosul
shareholders trails satisfying confrontation ctrl delicate dull beth prisons elsa sampling absorbed bucket bacter premiere currencies accompanying
nashville fatty brend locks centered throne bluetooth naming corrected promptly genome cope rounded kend tourism stark blowing unhappy litigation
integral reiter motors wonders roosevelt yields constitutes interim breakthrough cher prosec sperm inserting scra brewing runners plun dian
dysfunction exclusion disgr incorporate reconc nominated archer writings shallow hast thigh lamb favored cooler glimpse cheek jealous harness
disabilities outlook notify indianapolis abrupt encrypted forfe rabb foundations compliment adolesc monitors sacramento timely contempl positioned
posters investigative integrate rodriguez slides feminism datas bend nigeria airplane laden publicity commitments aggregate displaying respects
restoration illustrate pickup phenomena companions spill bridges insects scare zhang severity indul norms pulse horrific json olive discusses winn
hait rooted bronze commodity libertarian forbidden mathematics wires critically carbohyd chancellor eddie banning complications bangladesh bandwidth
halfway spinning neighbourhood entrepreneur peculiar imagery commem inclined cliff mediterranean poetry prosperity pills finale backward thri soap
foolish righteous coff abuses abusive thereafter prohibition ripped inherited bats flawed imaging digits hungary arrog teachings protocols curt
exemption mull improves gamer margaret intends depict parked marines judged weights apartments reinforce offender sore authorization delaware
notifications sunlight exclude mesh sudan belonged subway noon lakers coding disl confirms recruitment homicide jeffrey objection glow clarke norman
verification packet plag shouting ninth energ validity neighboring spine eventual probation romance partisan foreigners testify powell addict shells
sigh yale patron bannon tropical humble updating calcium competent steering accommodation hughes aesthetic twilight precedent typing lith arom
securing confined swords markers metabolic incumb saga priced clearance drilling notices bourgeois vest cookie guardians plausible odin conception
baghdad internationally wikileaks chooses combining radi mohammed chess timer ordinance accusing noticeable centres mills zoom compression surg chad
socialism travis occurrence fictional crush retrieve stimulus psychiat homosexuality elementary cellular intriguing foam assure congrat businessman
lied omega connectivity avengers toggle ankle nationalist mons aggressively hedge pipes blunt remotely refriger tiles rescued comprised manif prolifer
aligned triv coordination termination additions trio projections positively inclusive membr practiced starters intermediate interventions premature
psychiatric indie collar rainbow disruption misdem wipe tommy belly breitbart messaging intuitive moss discontin unrelated statistically sized rodgers
cared climbed consisted medieval hacked dire hermione tended legislators redes magnet perceive indictment critique advent vowed abortions stunned
advancing lacked schizophren elegant conferences canceled hudson frequencies meteor malcolm hobby europeans sway tide intervals ether habitat stevens
triggers chasing charm blessing textures liquor resil lily abundance predictable bullshit emphasized crust primitive enjoyable teammate kane summoned
honda realizing quicker concentrate erdogan responds eligibility pushes idaho aggrav ruins bans anat grind utilities yankees databases displaced
dependencies stimulation ravens associates therape deer repairs receptors remed marriages ballots hilarious inherently ignorant bounce easter deceased
musk merge projection leonard coconut traject imply curiosity heavier deserved phrases yeast reboot metadata repay suburban atop allocation moisture
pine aides underest berry ceremon pirates tense lovers craw efficacy toyota intest maneuver perfection seth clues levi vapor fortunate threatens
dependency blizzard chlor minus cryptocurrency metabolism pestic temp detective recovering cortex prejudice storms machinery compelled despair
vegetable beds colorful spike margins sympathy workshop burns debts theresa reflecting airst weaknesses weighed laughter router hasht hints finishes
vintage conqu wildly lingu protagonist renown motive antar mann rockets troubling organisms hass swall acceleration paired ethereum interfaces resent
artifacts competitor nicholas economically organised enforced varieties abdom bailey salv altitude gutenberg professors twins traps weed yoga
recipients westminster pools walmart selfish heights raids satellites lasts dame unpredict artillery cruise blows proximity enjoys repeating uint
processors gibson hurts aids advisers methodology dale deton connects contributors brass broker lengths averaging appropriately sandwich coordinate
navig goodness brake extremist mend refined lamp minneapolis commissioned colts bren bothered likewise schw mitch registry ruined maximize inconven
marie chill paradise starring latino suppliers brock serum encomp ambition arrows antenna bark bool railway tougher washing memphis famously
fortunately mindset sneak simpson livest landmark cement thrilled viruses theaters geneva unbeliev sentencing pins siblings northwest prolonged sakura
bour inadequate kash username battling curriculum soda cannon sensible wicked pengu dictators similarities hover hype shoots closes ridge replies
broadway intoler zeus proprietary requesting controllers expans oils chand printer topped decreases specifications kurt freel dilig decentral plugins
gregory fucked cleans boil nurses exceeded extremists traces comr sach masks regression advisor siege reductions statutory removes puck salad
promotions joshua expenditure delighted carpet spart jungle bullying nobel glen referenced introduces chopped neutrality investigator shelves
unconstitutional reproduction merchant metrics explosives sonia bodily thickness predominantly monitored martinez visibility queries genocide embry
corridor cleaned enrollment impacted disastrous claire indirectly carr prohibit educate conn stagger obese bree blades lawful appetite tennis
offspring structured aforementioned scaling curb stephan genetically cohort merchandise imposing offences miracle snapped foes extensively cater
recommends rigid tian certificates buddhist surveyed downward prints sans colonies danish spoil advisory specification shirts trivial mentioning
supplements supervision cooldown plaintiff mint afterward stretching inflammation tehran lining freezing inspiring porter derek luis exterior ashley
nutrients thrones finances specially excerpt recognised curry buddh notebook durable forgive personalities elevator warehouse illustration atmospheric
arche rewarded internally elephant bipartisan slowed override census cripp originated overwhelmed foremost reps lending sworn shuttle ralph hometown
persuade alexand combines vivid encoding salvation biden budgets texans honored blink unemployed clashes directing punct falcons shark damascus jeans
embark seize upwards exotic suburbs wend suffers herb fragile flooded owed whisk sudo promotes sodium correspondent identifies coincidence militia
infiltr pitching wizards venus casey sadly admire embarrassed tubes beautifully queensland decisive jagu clerk caffe wiped reim imprisoned develops
modeling shields lawn cardiovascular demonstrating parse israelis euros glorious conditioning helpless microsc harbor stakes unequ floyd damp
apparatus counters induce ahmed slam persist imminent shred phases edmonton armstrong kitty arose superf admir endure keyword yarn pathway hopkins
censorship instructor balloon swear castro gloss kavanaugh remarkably southeast validation pierre cautious fetch remedy scent beard patents unjust
potato forthcoming chef rift pads onset squeeze prefix unic epit extracted strains tops poem randy maple uncon slept underwater historians synthesis
frog vibrant subord cooperate greeted jazz intox supervisor fusion mercedes tours fifa culp pleas illustrates colombia highlighting exposing irony
carroll ellis rapt adapter corpse celebrities apocalypse hormones vaults feeds defeating emphasize steelers collectively mentality downloads
surroundings barnes flagship indicators grapp elemental athena sights capita voiced expired unstable quests handler versatile conceal obsessed cracked
dylan catholics slammed glowing tissues bacon irregular intentional compensate conventions winston assassin belgian dependence niche disadvantage
gasoline arnold feud minors trunk capturing exempl clinics substit payload troy fragments passwords gospel tenants darwin blat empathy camb madd rede
smoothly adrian vampire elimination crypto sorce respir reminis utilized hunters swan visitor thanksgiving hips knocking kenya casino motives regain
weekends stabbed exploited preparations endeav evan informational louisville plots hurting montgomery lanc retailer arising rebellion blonde
instrumental retention therapeutic seas infantry clint prompting bitch stems thesis cubs evolving recognizes graduation fertility milan boxing gluten
emir idol conceived lieutenant unchanged crimea depths empirical transm unsafe mechanic smoked slowing cheating metropolitan discovering pencil
pyongyang closet myst minerals musician permissions bing griev asserted colonel affidav seated paintings earl inning travelled simplicity overlooked
monkey overwhelmingly flint jama turnout dolphins onion crafting mercury arrange alerts gases richardson lowering acclaim startups merits awake
parental exceeds idle ebay traders connector overlap github cleaner baptist lungs cite pitched trophies attendees spatial prizes showcase ucla
soundtrack caval limbs lonely cores booked administer equals observing baron adobe linda merchants divor metals sums envision granting skyrim socio
selective sirius ivan furious responsive charitable leaning violates poet resolutions portuguese nickname deaf recognise entirety seasonal telegraph
microphone grains governed postp undocumented comcast assaults jenkins assessments downs superb taxation smiles undertaken enthusiastic twent
governmental autonomy prevalent nicotine awaiting deputies shanghai diesel duck inaccurate showc plaintiffs assange privat premiums elites ranger hoff
athens definite sighed evenly amber mailing crashing confederate juvenile reactor deluxe sanchez mead kidney policing tolerate biased privileged
beasts glas comeback extinction transmit doubles disputed injustice julie rarity counseling objections gast plac unused temporal therm systemic shir
nept scanning understandable canvas weighing astonishing reynolds opener trainer surgical adjusting frown suspend obstacle liberties uranium arous
henderson theirs downloading discern hath unpleasant screenshot allied persian monopoly atom redskins cancell cinema alfred signaling laughs forwards
reckless listeners vastly rude arises realities rode strive anecd shorts hypothes coordinated gandhi susceptible shrink cough lend positioning lottery
canyon fade kenny boasts emergence akin bert stip exchanged reservoir standpoint initiate decay brewery terribly mortal revis confess msnbc
submissions ruth azure laund renowned terrified warns pert unsure styl panc dictionary norwegian jailed maternal lucy unsigned zelda insider naruto
pastor informal bever yelling drastically eject neut thrive possesses shakespeare franco incarn founders brightness whale echoed eleven aurora logan
paradox hurd offended evaluating matthews payroll extraction supernatural ideals humili dani liberation stuffed mosqu campaigning occupy physic puls
archives venues turbo lust appealed timothy obsession savage sliding disappro voluntarily julia bounds crore columnist seekers nostalg newcom detrim
autop academics shen idiot teaspoon populated pigs oculus sympathetic marathon seizure subsidiary stef judiciary mirrors neurolog tumor lloyd clearer
stereotypes negotiated flown seoul disappearance vince grabs pedestrian infinity elliott mentor morally obey antibiotics freeman misdemeanor
animations intercourse newcastle territorial munich commanded pitches croat ratios mits accumulated gentleman intervene alzheimer succession separat
correspondence shiny sulf miserable dedication specialists defects jeopard ambitions arabs preservation ashamed resemble enrich playable harmony
weinstein poisoning wordpress valve romans tortured balancing acquiring monte aura atlas intrins benghazi camping tapped rhod caffeine apples
welcoming applaud austerity sucks tabs paypal backpack gifted scout chin omitted negatively accessing ambulance headphones snyder borrowed aviation
stall uniforms simmons rallies stuart gangs vault designation constituents heck cows commanders differential catherine brace perspectives intric peas
tossed lopez unfamiliar relieved airports freak owen firefighters authoritarian browsers poke covert contributes contention consoles chromos visually
eisen jewelry delegation accelerate riley slope indoor hugely tunnels fined directive forehead skate recognizing overweight sounding locking excav
elbow handsome adequately strips crackdown passages thoughtful prostitution ballistic coleman admitting bitcoins fairness supplier catastrophic helen
endangered cheat unified suppression analyzing squat figuring coordinates chunks subp forbes jupiter erik legitimacy dental deficits contamination
confisc clare ruler feminists rabbit glue volatile shining foll impaired supers clutch prolet yelled kiev situated annex automation jill remastered
linem wilderness guinea mainland secrecy punk handing sebast journals congest schizophrenia misogyn reacted plural plum bargain grounded disse atroc
minions myanmar expedition explode extr adhd hardcore dile vaccination contests fren disconnect persecution healthier trinity specialty cooperative
hulk celebrations klein unreal partnerships adopting splash hezbollah envelope wherein telev myths rigorous communicating observer rehe apologized
expenditures hesitate lenin unpredictable renewal postseason exacerb betting elevation solomon redund mumbai reproduce popped incompet mystic dana
masturb geometry trajectory distracted welsh rugby respiratory triangle undergraduate rightly referee lucrative unauthorized resembles derby pathways
endurance stint dots nationals whip learns detailing broadcasting baked hussein geographic judging stern storyline burnt pave campuses mutations
captures compares badge erad strap proudly withdrawn pierce annotation happier staffers activism perf alright commence opioid amanda indo moto
legalization tasked refreshing perez infringement rotate storing warrants judgement brist outrageous valentine relevance terminated dessert fulfilled
prosecuted migrant cultivation vern metaphor recruits enthusiasts frightening owning dislike knives loudly apis warmth topp gunman saturn waking
comedian believers paperwork lament pouring cruelty tread modifier imperfect clusters cherry inauguration embodiment overr explosions princeton andrea
incorrectly earnest pilgr sleeve hears browsing diving bargaining arcade delegate jacksonville stagn sherman suburb converting arist chambers amino
madness ultr wolves cracks accidental initialized unnamed noun hostage ethiop unrel atoms purported gallons monica sorted traced undergoing sacks
proportions halluc warmer grabbing realization burke enchant abundant civic reper penetration shattered vinyl obliged plaza frontier davidjl jays
hurry hopeless safari wary notor occupations possessions inviting predators accelerated cube transplant screenshots gund travelers sensory fiat
charming enjoyment compilation schne copying flore disciples exceeding smashed conceptual romania brent grap nails procure confirming eden engineered
hooked disgusting notre kidnapped hacker jade creepy drawings cyclists goblin optimized staged incapable rewarding contracted sticky tomat nitrogen
duplicate intra dock outreach mammals snaps winnipeg incurred runway hawks survivor mushrooms crisp developmental paradigm chaotic bacterial commits
cosmic vain carved thief cites edinburgh diminished acknowledges microw hera seniors whereby unavailable nate slated rebecca grammar headset cursor
excluding feasible labs ferrari polite staggering galactic superst paran specifics panama heroic incumbent crunch scoop blogger sellers medicines
outward inquiries psychologist sask contaminated branded abdul paragraphs mins correlated impart milestone undercover marched chargers feminine sham
prestigious sung outdated perceptions dodgers deficiency joker retrospect diagnostic harmless aval transc robertson hostility discomfort imperative
statewide symm loops autumn shaping quot crossref dell vietnamese valkyrie rebound shelters insisting kenneth penal replay dialect spiral quarterbacks
hull sterling spying terminate protesting uncover boycott realizes pretending framed descended rehabilitation borrowing buch blur translates erupted
successes plague gems stretches storytelling traction ineffective luna tapes analytics programmes behold sack housed unusually executing moroc
editions smarter outlaw vanished silva philosopher evacuated visas malt niger cairo reinforced screws oceans brakes terrific tones curves inflammatory
batting unpop riots orgasm constructor antagon theat deeds mccl grassroots surfaced shades neighbours advertis merged anticipate slogan disrespect
subpoen waiver vulnerabilities huffington ellen fills nike cumulative friction scans vienna performers bidding leaned prix twitch callback accustomed
freedoms lump worm platinum newborn fantas sympath ubiqu outputs allev prag favors burial nurt unlocks conquer electorate kurds samurai fallout
kindness boulevard helicopters criticised polished remix recons barred slap empt hats cans somalia surgeon randomized proclaim toes ample preserving
disbel silk enterprises affidavit advertised hashtag forensic vacant duel hallway kirby skirt analogy tomatoes meyer appointments masc alley charities
undo destinations destined implements harold optimization kilometres impairment unsuccessful swiftly glasgow nutritional bloc wholesale neglected
launcher announcements rotating rests templates replaces gilbert illnesses schedules heterosexual herein coerc decreasing deportation weighs bengals
joints simplest reservation sanctuary vegetarian anticipation enduring departed sidewalk prohibits compute bomber distraction endured practitioners
disturbed drank surprises subparagraph peninsula gratitude caesar skies champ agreeing messy devote walsh dumped accumulation smokers inspector vita
researching celtics cloak terra multitude reliance artifact alarming reflex excel weakened costumes uniquely sorrow mansion grove sniper undis
branding ahmad lakes corey inheritance packing regulator contested melissa unpopular stacked yearly stare assessing beverages competitions
strengthening melted bounty declares customize composite contender insign disasters judgments variance melting syrup innocence continuity unsupported
fragment crosses mitigate raymond tomato stumbled differs raspberry ignores tant relay bisexual confession dement heather hyster drift wald luckily
expire unpaid trent unarmed illicit tottenham sting saddam truths sober usable stacks sylv northeast domination mour programmer backyard creed
detectives messenger looph gateway doomed slices emailed perl renov southwest optimism exile zimmerman railroad replicate comfortably telescope
honesty richest outdoors halls contend submitting naive poised socks discoveries puzzles ceased boiling discrep deduction amsterdam shane posing aclu
theology hank allegation indefinitely commodities manit tenth knicks invoked caucus ounces buddy iteration gonzalez livestock wasting wishing tumblr
tapping nationalism squares append stubborn cind tearing dayton morrison accuse torrent declines negotiation bashar fang roller inexpensive wors
unbelievable nause entr hassan paused circulating crawford wandering sophomore queer padding folders meaningless candidacy whistlebl cigar dubai
posture hiking starbucks eugene wyoming rocky salmon bilateral celebrates releg pseudo rhode attribut tuning cocktail spoon brutality unite microbi
reich amazed falsely highlander crist victorian distributions einstein epidem heap ranch anthem reapp auburn concurrent homemade chassis merger laps
debated silently restraint formidable filip sacrifices dwarf tangible minecraft representations thirst gestures packets berg fraudulent criticize
blaming slash eston proposing whales therapist subset leisure culmin admiral memoir folded sexist readings embarrassment continuation evacuation
kashmir disposition bolts insurers retaliation misery unreasonable genital onions patt conceded forc hernandez geoff cries homeowners stitch statistic
headers hates heel annot lebron footprint seizures katie reservations saturated biblical trolls drums cush disciplinary schmidt sixty kushner pund
conve qualifications verses narciss charlottesville interrogation wool alleges jackie worthwhile crystals juda comprehend flush absorption frightened
buys bucks appell championships listener decorated sunk sara seating employs gigantic towel latency upheld playground mant stereo exceptionally rays
recurring upright abduct goodbye alphabet courtroom diplomats barbar aqua maturity instability apache fasting acquaint forge armored philosophers
myriad comrades remembering corresponds programmers lynn olig coherent jugg semester emirates dodge faded statutes headache wifi circuits cylinder
conflicting slightest forged rulers submarine allowance kasich australians crushing advocating sexism fueled reminiscent obsess uphold beverage oscill
poles gradual exting liking omar consequently synthes pains interacting rumor scientology spelling extingu remarked methane imagin wrongdoing bigot
demonstrators calvin villa membrane benefic magnificent boris detainees herman whispered physiological limb manipulated bubbles pseud hydra bristol
stellar kell interestingly dragging ecological gent benefited haiti polyg prow reconstruction wast psychic greeks solicit influx proliferation taxable
disregard escaping ginger withstand devastated injected turnover irrational reef bankers criticisms tories nood distortion tasty divorced hayes
traumatic sabot renamed seaf seldom webb boolean refrain shutting utilizing attracting hers discarded cursed curtis sachs vista subreddit oval
installment glac lgbtq acet successive nicole circumstance guessed perpetrators handc viii kidnapping needles advertisements exhibited fortress
cancers prud atheist balances shawn landsc petty excellence translations parcel chev ambient villains taller leaking infectious bureaucracy skype
hypocr pitchers guessing villagers tunis haskell specs invari glut impulse honors jurisdictions singles cues underwent exaggerated dubious flashing
istanbul insp franken sadness ironic protestant unaff productions hogan perimeter spontaneous downside descendants radically bach liabilities meme
fingerprint undertake sims hypothetical charism admissions exercising vocals litter variability eats elephants strat settlers inadvert nerves
mitochond compressed trevor tweak pinch cancellation focal demise cracking collaborative explores herbs configurations sanct degener deepest screamed
primaries filtering assemble myers punched innovations func fracking settling adolescents rebuilding transforming parole booking emerges dungeons
trailing hugh versa greed gardens contingent leafs diplomacy upgrading elic relentless covenant punches hdmi foil implementations await umbrella
foresee circumcision peripheral withdrew anders radioactive boarding overthrow motions thankful bris predicting killers incub proclaimed packaged
heightened stamps persuaded ensl cardinal solitary possessing cork evid extremism lunar clown festivals someday touring beaches purity emission chord
scripture annoyed skeletons pupils urgency councill lifes confessed harmon staple swinging restoring haul futures strategist lateral bard rhodes bened
coil sucked rapper tendencies lauren browse overc beet typed discounts austrian dismissal averages allegiance commentators midwest pharmac stainless
countryside pinned crises standardized docker patrons spice mourn laundry equip sherlock issu americas systematically contra sally rationale carriage
peaks contradiction props namespace cove presumed diana hamm stunt observatory smells cockpit duterte oppressed peru monsanto commanding fridge clicks
majesty ecuador kuro rituals captive ounce disagreement slog exercised solic rainfall devotion robotic assignments vocabulary suppressed johns warp
statues advocated peril hatch lifelong cheeks numbered heath kissing waving violently skepticism annie genetics onboard friedman mythology eclipse
skins glyph regimes photographed unexpectedly impressions supremacy sang aggravated abruptly excuses costing ghosts reimburse recycling lectures maid
oriented respectful unloaded alternatively hugo decree buddhism congo joyce acknowledging hiro maced hoax pradesh aunt distributing tucker cambod
extrad penny stationed undertaking chickens stimuli prepares vicinity workshops accusation histories churchill neon baff symptom manuel banana koreans
praying embracing daylight brigade hannah clergy alcoholic proposes calculating stimulate splitting indy domest forgiveness periodically britt
arbitration schneider maya snakes blasted mysteries revive opera orphan specifies mets fireworks prosecute tillerson debian charleston acoustic amuse
cardiac fuzz bites hazardous brighter stephanie christine bolster antit visions inline irving inconsist kumar schumer voldemort frederick alleging
forecasts spiders facto bombers homework corro brendan stakeholders millennium transferring interpretations upstairs vagina ingest orion joey sandwic
immortal flipped converts installations bulgar lure narrowly grenade ging underwear chased parenting hamb blaz anarchist nokia fulfilling puppy entit
sebastian shooters richer tempted tore devils assurance darren whichever universally workload deprived casts affiliation lact notions transcend spinal
defaults prefers spicer pity compartment monroe corrections dopamine roomm speculate restrictive rampant lent vandal boehner narratives authenticity
thanked betrayed dexter keywords ethnicity widget pasta billing trilogy sniff nephew princip marxist dissolved contexts totals organizer uprising
goalkeeper steak buzzfeed solemn scand popping adhere wolver unin recol mimic predicts keeper deception learnt diary conditional relic invoke pont
cellphone speeding tackling nude manafort majors logistics weighted sickness dividends fernand meanings backdrop debuted isle regulating pops
commenting rivalry bean judy rented forefront baldwin yielded marching reside andrews torque exams ransom sunset hein aboriginal organism chorus
denounced biography turnbull ferry wagner supermarket sith nominees dictatorship announces neptune monarch invaded kidding tray photographers arcane
discharged evangelical interchange filmmaker salvador wrath projectile employing rath indications args tilt modular assisting redeem worsh
decentralized arrays accomplishments mutually obstruct misrepresent knowingly schultz obsolete bait enlarg reconsider sergeant diane fost stirring
spacex medd triggering screams causal awaken dispatched organizational dilemma hooks validate potion claw burgl quir brennan durability bombings
culprit enforcing reprint sinister burger vinegar prevailing conway collects quantitative horrors slov lays nightclub davies bride scarlet revival
softly electrom planting swallow laptops peanut lobbyists joan resisted outwe retaining poorer syrians hammond weld thieves gust broadcaster
airstrikes pedal collectors vander mesa dictator drunken cornerback skipped audi haunted paladin stigma monkeys hawk avatar prostate unden warhammer
sentinel segregation drills spur cafe imaginary guiding swings begging strongh rejecting pedestrians concessions beams fibers instincts coating
corpses communal energetic nowadays dwelling tally coward generals horns circulated robbed harassed inhibit composer spotify spreads suicidal noises
stur theoretically similarity sliced imped menus abdullah undead fonts sustainability flick razor wording populist criticizing muse cardboard kindly
fringe governors timeout redemption alger waved astronauts swamp finnish candle tonnes spun fearful caus inaugural isil watchdog balcon gallon
doubling implication doctr recap societal commercially spicy superiority tracker patriot consulted listings slew hottest diaz massage paraly pony
cartridge snack lamar leslie mater snipp jointly brisbane ipod pumping goat sharon coron anomal sculpture scheduling daddy eyebrows curved sentiments
drafting nominal constructive corrupted cros chester almond feast warcraft checkpoint transcription tweaks relieve performer turmoil fluor decom
barrett tasting ptsd judaism cors ming distorted agon reliably glor adren microwave alban rochester simplified inflicted takeover yourselves muscular
ingen cruc crate unidentified acclaimed frances nepal gerald kuwait slain goku cody dismant dataset hond patterson palette lodge planetary petersburg
hailed enumer exploits drastic architectural wrapping widow slayer temples lucifer flickr scouting louder beforehand politico builder derive poker
ambiguous lifts ribs proportional pertaining kindle negro reiterated cornell owing essays burdens illustrations linkedin jung redesign reversal
adelaide sinking grimm footsteps prose overturned contentious pointless deposited preceded golem flatt councils stressful resh wheelchair optimize
peek oneself transitions laundering workouts spikes dinosaurs discriminatory vein burton cubic unofficial incarceration syll everton serbia mickey
antiqu factual nare highways glam dividing squadron martha births wong derivative wwii therein separating ratt municipality monk scrub operatives
constituted protested typh floods cosmetic rooft caucas antidepress incompatible generators hungarian metallic expelled residency dresses clement geek
cemetery crawl tyson pardon strengthened fors mond visuals beatles poorest aspirations ceremonies intimidation trademarks pairing overdose revolt
verge podesta invasive profoundly lest shrinking errone chees hinted contacting labeling lite expires destabil feathers steer programmed vader miche
sleeves bully compress awhile calib sponsorship identifier shia cleanup vibe outlines deported centr boulder buffy injunction harley dumbledore clara
sacrificed freelance evidently retains finite repaired periodic asteroid expressly astros scaled geographical rapids elastic mohamed discovers
telecommunications scanner enlarge sharks psychedel rouge snapshot pesticides degradation disguise biom equations hazards virtues elders enhancing
combust concussion contraception kang expresses exhibits wheeler expands reconciliation purse discourage spectacle wraps impending anglo screwed
encouragement confuse discard bishops garrett masculine fatally surrog bios watts resurrection nutrient depicting sprink muff specimens dissatisf
tailored holdings lotus lantern pensions joked hardy rails emit slate smug spit jacobs restruct regeneration energies connor resurrect presently
bruins mang boosting nypd megan pics rash ducks embro craz zucker knox arduino stove heavens herd fundraiser proponents jelly monks advancement fetal
outfits staircase customized mapped torres methyl approximate hansen crossover standalone invites graveyard escort predecessors enzyme durant
outspoken disgrace cheng rena outraged newman aber bers recreation pedoph presentations rubbing humidity respectable thriving dracon sticker sunny
husbands kris malf molecule cone catastrophe communism halted guant kanye wander simulations nolan menstru casually clemson certs slid toast fortunes
fals fiery nets atrocities justices insults vernon shaken persona experimenting graphical whopping advertisers bids destroys undersc ants glanced
indicted miscon abide coul capsule chrys undes citation dictate quarterly alexandria springfield geography utmost exxon barr disagreed cyprus dementia
ubiquitous consolidated creamy timber insulting soros bulgaria sucking davidson collateral plagued gardner sixteen comprising viking automobile
procedural disappears daring podium unhealthy mund pyramid kissed dreamed greatness spices compuls swallowed genres dispatch mates recharge yorker
galaxies celtic affirmative tutorials rosa fats adulthood sectarian checkout martyr chilling congestion boast examines startling babylon odyssey torch
professionally steals sturdy johann medals filings fraser multinational feder worthless pest gays borne percentages potions lebanese rang macbook
unanimous lenders hangs franchises isolate disruptive stitches scorp dominion supplying turret brackets noticing shannon afforded janet narendra
obstruction fargo orchestr delet militar greene unleashed weber adjustable caliber motivations lanka angular philanthrop dehyd toxicity retali
massively daniels carcin routing npcs waived guatem relaxing quart guarded outgoing rewrite phenomenal longevity impat nissan odor militias tolerated
bradford surreal resemblance carbohydrate accessory toughest funnel condemnation wired tycoon selections highs rune crafts reclaim looming
beneficiaries pact baylor hemp youths xiao ches endeavor hippocamp dinosaur indonesian calculator restricting weekday shrugged touted maxwell diplomat
repression constituency napoleon bulb cisco resumed manitoba fabulous amusing questionnaire penetrate filmmakers stamped thirteen outfield forwarded
appra aided unfocused wendy rejects leftist providence brid prophecy intrinsic wont holt famed registering fascist implicated chandler abbas
unanimously addicted helmets antioxid waits minion porsche dreaming cain unfor nested tying marqu clicked expiration blessings addictive jaguars rents
siber tipped fitzgerald hierarch wavelength quoting communicated inmate erected unim claws superstar lenn sket niet perks affinity openings
discriminate grinding jenny asthma homer registers creations lithium applause turks scandals bake santos vegetation flux clarified mortg disclaim
induction infl atheists weaponry derivatives snacks churn capped duct sailing reactors lomb choke admiration swung trainers harmed pandora mushroom
gentlemen lingering graffiti quint florence payable depicts enclosed enactment steele mouths stranded enhancement whats healed labyrinth yosh clippers
concerts stickers termed grandparents thrill substantive stray repetitive qualification zimbabwe simulated unsc summons disconnected gujar erase
uncont shepard alerted operative negligence supra prevail belts tighter inactive exponent willie heir currents bengal breeze wesley pronoun deed kling
inflict punishing subsidy herbert deferred shipment alle scrolling scanned libyan torso imperson schwartz pissed sapp isps supervised adolescent
attained bunny miniature mourinho innate tempo provocative benedict bolshe turtle fluids cousins gears upstream disproportionately undefined electrons
commemor irresponsible sage lime confinement calorie differing sina intricate differentiate interception ankara rept solitaire remake dared debugging
graphs nigel pillow progressed obedience rehears cory dept repent pleasing shortages jurors rcmp tsun comprises spies precinct urges timed stripes
discrete archangel monuments homelessness commentator racially ethanol parish dong awakening deviation tsuk recess lymph stefan loosely interpreter
bigotry grenades mandated pedro lava cynical scrolls congregation ibid ferv disappearing arrogant maver abbre extinct executable prel resentment
comprise aviv interceptions prolific erin psychiatry mccoy bricks ussr laud emerald revived damned patriarch cheapest deprivation thumbnails ethan
qing opposes plummet suing pronounce resisting yell induct personalized viewpoint existential evapor aisle reflective entitlement devised winding
accessibility johnston croatia textbook slider grandchildren cerv eternity tweeting speculative pivotal classmates blatant lakh borg hoffman adorable
spawned implant luxem kens pumps centralized freshly outsiders dart heavenly ripe caroline classics retiring dealings punching chapman stal exported
numerical keystone trending altering africans temptation prestige bahrain grande resides indec perpetual worldview filtered ensu vitamins ribbon
sincerely eighteen contradictory glaring expectancy conspir monstrous handic pumped indicative rapp avail lego twentieth valuation affiliates enzymes
imprint installer speculated defer inspectors suns informing syracuse glove authorize contracting photoshop attractions multiply equilibrium edgar
fourteen misuse abusing ancestry worms thicker peasants vind conquest mocked cinnamon cald gallup avoidance incarnation tasted neal terminology
directories shap preferably glitch surrendered pathetic donna avery whiskey fixture bets leicester flashes masked computed defeats osama vive tariffs
inadvertently reaper stereotyp curl frameworks flavour permitting mozilla murderer rested owes comparative neighbouring biases gunfire pervasive
albany unsett leeds thats perme blitz intimidating eccentric simulate shipments seasoned experimentation fronts unatt erosion quin earns
accomplishment irrig teddy conquered asserts manipulating transcripts plotting betrayal displacement royalty municipalities canal resonance
guiactiveun braves hereby shareholder strangely admired plight bachelor armenian unman zionist automotive sidelines slick renaissance ping shortcut
blvd bursts clamp mish sorting correctness scandinav cavaliers jaune detrimental stabbing poisoned fountain mari rains headaches landsl zhao hops
kurdistan exploiting hypocrisy gunshot amen marketed escalation curtain counterfe contenders phillip filename resembling staging chloe wiring strokes
policymakers arkham assistants deport sega influenza kobe skinny incremental dome losers betty dens retrieved architects ethic simultaneous dizz
smuggling stockp disclosures coral pike ruthless ensuing congressman believer unspecified mord knowledgeable straps turf marital flock treasures
modeled pioneer miranda kant provoked breeds pastebin brink rumored unseen garnered tattoos hesitation weaver therapies consultants residual mali roma
remedies adaptive barcl wallets pelosi slipping alliances orth perkins drying vaguely dion pneum rubble morocco bots balk brethren logos gobl
subdivision pawn squeezed morale knot divisive boosted newcomers scouts nineteenth osborne empowered psychopath mohammad anarchists stockholm
deploying staffer discounted ante repetition parody lively horus pits venice pens eyel joking inval belfast creditors skywalker ceasefire seals felix
tresp schwar beacon immensely cheering nicolas drained azerb floated superv mystical apostle enhancements penguins isaiah jerk stalled
cryptocurrencies roland lumin kazakh financed collusion pediatric neatly sandwiches tucked balcony earthquakes hefty specializes stresses sender
misunderstanding epile provoke dismay donating randall conveniently coca tents partnered objected attributable repeats inert miguel hawaiian artific
azerbai appliances nationality asshole notch intercepted continental swelling lara tempting overseeing gingrich alterations patreon havoc disciplines
notoriously tremb mortar marty sparse inward antibiotic elusive assail battalion diminish europa disbelief blasts boyd undergone grill dwight
filesystem clocks wrapper folding philippine perth ashes accumulate whim repo incorporating bailout linguistic disinteg cinematic neoc boiled receipts
disposed notwithstanding unreliable mediocre tram tasman shakes manifesto satisfactory shores computation assertions volks gravitational throttle
tyranny robber shrine nucleus usda bowie sailors amounted maritime quran ecosystems graduating philly malaysian climax bury conspic southampton
escorted brutally pillar jude amnesty reminding flashed swipe graves guer shrimp analytical tablespoons researched disrupted jour replica cartoons
swarm rebuilt collaborate raging demographics distrust pumpkin regrets fatalities puppet stam rewritten fascinated vectors tribunal mats renders
kaepernick espionage summ ditch spreadsheet mutant initiation punishable thinner khal intermedi gotham eagerly vaginal predator disparity amph
outskirts skeletal issuance exits greenland hourly fantasies disob demolition enlisted misguided ensured discouraged flank cess reacts sere serpent
calmly bleed amusement antarctica scept sprawling northwestern apprehend guiname backend evidenced externalto unfocusedrange guiactiveunfocused
guiicon externaltoeva externaltoevaonly corrobor patricia dumping neurological clintons molly terminals flare encoded autopsy exemptions royals drafts
lame cunning spouses implying loser vigilant impeachment augmented unintended watt recognizable coated ideally simplify pleading unravel paranoid
passer inspections shoppers informative supplementation vega gujarat cumm venom reunion geop corros replication blazing inflic lindsey gloom
undermining advising overflow echoes impuls async mirac pivot bloggers verte prohibiting panther omin hateful murdoch asymm informs appendix arlington
medicinal reaff thighs markings raqqa morty debunk leone mortgages mash diarr consciously destroyer dashboard millennials invade commissions auckland
broadcasts frontal crank rumours steril booster invaluable unintention scrutin gigg engulf proletariat hacks slime elliot telecom arbor lifespan blasp
baggage sorcerer remnants griffith subaru recoil passions abolition pillars livelihood roasted hutch dividend knit daunting disturbance shale
cultivated refrigerator commercials thinkers chop suspicions tagged stylish tails seism cowork forcibly thyroid polymer chal bliss pinpoint labelled
estrogen visibly outsider dissemin dishonest bulletin ramsey manifestation chore sanctioned culturally theological strut handbook constructing vitro
maiden jennings garment rutgers stafford wellington intermitt ordeal plugged redux surpassed parallels veil readiness modifying marble infrared
auditor executions beverly marxism kali haley formations dominating flyers disciplined yugoslav vengeance landlords ogre piercing congreg scorer
nickel rejo masterpiece inhabited opengl arter plur mastery longstanding wines televised bayern enclosure prophets uneven dwind sloven insistence
hardship plead reviewers cured dota whipped bouncing hispanics cannabin zack coats prowess norton plainly freight inhibition clam psycho treaties
indisc resilient interstate slack mundane establishes strained nond caste unfairly parser otto furnished outset metic hides educators volatility
toddler nascar grape splits peasant reneg hyde realism oxide mounts biting collapsing postal museums detached respecting monopol workflow persistence
redundant bending revoked offending framing printf construed coded chast xavier dunn coffin securely raptors inception psychologists sheikh blackberry
cakes gian asians pundits vaugh gavin hitter drowned chalk zika measles distort antibodies uganda vomiting occupying evasion promo electr blueprint
depot alleviate somali nostalgia shepherd cavalry torped sank goalt fischer noteworthy inefficient dynasty distinctly estonia openness gossip ibrahim
petroleum hogwarts caves safeguard durham subconscious piles garn avoids bleak insanity twists faulty piracy impover rugged sands natives freezer
newark archaeological blockade allerg debit milton willingly disproportionate oppressive diamonds belongings bells imperialism exploding rant
nominations peacefully vibration ropes ivanka booker owens snape discs prominently vulgar skipping tsunami urug faults detector bastard validated
unsur affirmed fascism resolving chavez detract rigged homage bruno presses humour spacing cambodia liquidity soviets fernando slug catalan scenery
hearth constrained goalie pearson taxed fetus alexis reconstruct extremes concluding deductions groundbreaking moons electromagnetic amidst viktor
commute anaheim fluctuations noodles copenhagen grizz pipelines scars visc jumper cognition witnessing adject glitter calf spoilers succeeds chanting
slogans tracy mornings lineage intensely flourish klan darth nielsen tumors procurement yorkshire raided mustang deliveries shutter cerebral bipolar
debating dixon draco eman comparatively fertile depressing superficial prominence mocking psychiatrist noisy slapped para nour goldberg teamed
literacy leah doyle emitted evade maze wrongly lars stereotype pledges aroma acre breweries hilton thankfully canucks coer undermined blaze famine
desperation corinth kathleen attendant respondent boun paved unexpl cheney cull confronting lithuania stalk vener resilience abandoning debbie
gradient expansive fung bounced precautions clarification dagger grips rivera hostages compliant alumni cybersecurity invariably soci lawmaker
customization saskatchewan spared discontinued computational motorola supremacist downing nikon catalyst macron unrealistic colbert krish tate robb
winger georgetown geared jihadists steroids linger immersive outweigh transforms referral oddly wenger bows thorn raider shiite mound competence moor
diablo withheld ostensibly brom denomin plunged pamph downright fading battled seafood figur squads interviewing aspiring clauses luggage hose systemd
descending uter voyage vanguard volcanic womb beginner detecting breaches olson restrained rulings humane assaulting vigorous perse intolerance
snapchat dummy separates mahm windsor intuition disdain donovan condemning generosity panties specifying crystall rupt apprentice profiling sideline
obligated occult bureaucratic ethiopia insiders substituted saul builders stationary doubtful vigorously thrilling carey borrowers parkinson jamaica
satir insurgents isot karn monaco conan starred pacers tipping cavity goof emphasizes regrett novelty envy indifferent rica freddie adip breakout
hurried huang roaming ricky sigma marginalized edits specimen vertically audition caster cron liam deflect versatility mahar hort shim airing
spectators thatcher templ declarations overwatch onwards manila politic portraits pavement beginners shortcomings comet hospitalized peel readable
malik muzzle benchmarks hicks overload immoral fries reproduced formulation coached loki louise uncond progressives wreckage brushed basetype zoning
karma trader seeming tunes indoors peppers oversees rabbi raft textbooks inconvenience donetsk implicitly boosts sensational greedy inexper vale
tighten ancestor horde grandson fracture moderator estimation parach barric compass allergic wagon zinc rubbed fuller luxembourg hoover liar cobb
selector brawl troop guts tibetan routines summarized tranqu gmaxwell apprehens poems sausage webster themed lounge charger spilled sunder disqual
ethernet helper horrifying allan holog rafael atten emanuel upro hunts counselor toxins banners greeting frenzy allocate consolidation fletcher mckin
scholarly egreg insecure victorious singled elves camoufl conditioned compulsory podcasts frankfurt neoliberal belle trusts insured bucc plains
sabotage lodged salem seventy whisper mating salman angered collisions extraordinarily coercion permissible pointers dissip theatrical forgetting
finalized booming goodman dominican precipitation integrating intestinal matchups blockbuster loren levy preaching authoritative dishon chatting
recreate delinqu broth scholarships blended alarmed blends hepat persecut sweetness forfeiture roberto insignificant seaw emblem seriousness parsing
substitution pressured recycled proficiency wester mantle clayton practitioner township condo utilization nausea dems formulas challenger defective
pubmed yogurt norfolk moody distributor extracts viability exposes starvation dodd closures complementary sasha monet articulate scrim prostitutes
severed attachments cooled falk policeman prayed clut anomaly guatemala exposures opaque disguised pots frowned poisonous crab treason ranc escalating
warr mobs lamps sunshine brunswick spelled pluto meats stomp zhou leviathan orwell aloud bumper cecil serotonin cultivate mosques reactive fedora
defenseman drowning thriller accelerating directs painfully whist sock infinitely citadel lieu candles pessim inference powd paints dazz inspir
showers benign jiang envisioned shroud shuff segreg revisit substrate eliminates stamina constraint appropriated intellectuals restructuring levin
runes delightful carbohydrates expo transporting ringing scarcely urls prototypes narrator cpus barton decidedly reuse forgiven seamless softer
transient orbital fulfil dynamically armenia pige veins soaring jihadist gamble careg inflated emmanuel shocks splend commenced fulfillment
embodiments hail catcher jazeera volcano stabilize intensified abrams humiliation centos heed galile abolished thomson wass isbn deem exceedingly
smartstocks doorway competed nationalists groom disposable tolkien biod avid elon artificially advisors inferno tedious carrie trope sandra decimal
gundam entrenched marion fraternity latitude enhances shines breadth capacities bronx sexes differentiation heavyweight migrate exhaustion cuomo
guitars clones warranted salvage disks ngos martian addicts amazingly gpus tamil basil impartial hamburg canned ironically compassionate hawkins
cathedral rallied quota completes shrug revise treacher quasi deposition confidentiality imbalance spanning nora sacked finely rohing shitty scalia
referencing classrooms zuckerberg scotia savior crater roast influencing stature bathrooms nath hypert commencement moderately distributors
breastfeeding amer messed jensen blackmail conversions scientifically mantra ivory submer doctrines athletics attent prescribe encaps secretive
egyptians carpenter milo capitalists briefed basin plunge kaiser safeguards oste mafia druid smoother footing motorists masculinity mism abdominal
tavern escapes sacrificing intimacy anterior motif graz visualization guitarist trotsky mori wards toilets teleport sundays plat esports katherine
hassle mick airborne spans chili aperture volunteered fres uninsured fuse erotic advertise attends smoot willis blond stronghold prosperous boasted
pharmacy rockefeller thumbs motherboard shack wisely backbone suicides mcgregor brav designate cleansing humph payne vested stringent unsub summed
hercules ragnar characterization savvy dawson misinformation insulation corridors airplanes noct shun schema horrified shard grouped ghana beau julius
maurice sequencing radicals anyways reperc handlers hesitant campaigned simmer rods melody convoy screened ultras antip islanders fetish ridiculously
kart mitochondrial interfering overfl acne kerr baltic petitions subscript phon raced daytime engages qualcomm miracles memes orioles hairs slippery
remy caramel merlin cran apologies outing countered firewall repealed ceos chapel wart subscriber begged semif preach revital punitive shortcuts
instituted warsaw abdomen superintendent contradictions landscapes clust volley tandem robes promoter eloqu plato derrick prioritize honduras mayo
volkswagen precaution mell overlapping mormons coch maduro jars cane physicist maggie depiction mclaren slows commissioners willow technician
homicides truman shader rever hardened whereabouts redevelop carbs travers squirrel follower sings rabbits documenting misunderstood premie skating
passports fists carlson priesthood antis familiarity sabb cram legalized cuisine fibre arabian saddle denis multiplier stirred customary billed
multiplied flipping crosby fundamentals flam tablespoon liberalism palin patel surn reloaded coined pragmatic trailers silhou probes circus bain
lindsay abbey concession gastro sprite gimm autobi wonderfully haram theorists sleek antarctic potassium lineman cereal mathematic astronomers fares
youngsters mistakenly hemisphere divinity attracts playlist porch incorporates soak asserting pablo fearing escalated robe brighton symphony inexpl
cigars jehovah liberia lubric narrowed ember murdering downstream tuls progresses establishments peach gomez hive mixes hypoc sane dangerously katrina
idlib circumvent celestial dalton subpoena persisted primer synonymous notation forbid projectiles fiercely uran nicarag guarding leveled condoms
nightmares kinn roommate hygiene formatting revisions resurg indisp gown bystand punjab gamb importing locom berger showdown responders takedown
mattered predictive overlay vick conveyed defensively approving tiers saudis demolished mono hospitality ariel torah blah belarus banker mosquit hust
torment standoff amplifier daemon mattress obscene compiling prank vulcan mourning blaster sediment reacting translator bogus baptism sibling freud
continents tolerant horribly midi impatient norris defends anatomy drawer canberra patriotic undisclosed farewell allison conco acpi enthusiast
inventor mysql draconian terran commonplace sheffield citations unix unleash piper nano succumb reluctance wiret combos charcoal fairfax driveway
technicians magnesium slut growers keynes borough bethesda chant compositions mildly meddling agility synth exclaimed contamin manor praising manners
lynd bowling mandates reconcile damon portrayal cushion mitigation erased deficiencies hollande bred pregnancies emph planners outper perpetrator
motto ellison admittedly azerbaijan millisec combustion lund fabricated battered sidel notting jerome knots surgeries courthouse mastered hovering
bran alison safest bullied barrage veterin bhar piled honorable institutes soaked coma gmail canadiens instructors conceive easing christina caric
shovel puff seamlessly acquisitions autistic fowler mustard copyrighted leds custod huck federally microbes overrun tornado adjud intrigued burglary
saiyan kathy andreas compel hindus righteousness demonic gregg crusade sinai derail noticeably ober unnoticed concede captivity crusader stride algae
policemen astronaut depended ventures tits condom indent uploading mindful contends calibr oecd handheld semantics bundes reno trin cleric invading
enum allege thru sailed emulate insecurity crou accommodations incompetent slips iphones extras slaughtered crowdfunding filib ital enlist catalonia
scots dissolve standings beneficiary aquarium powershell brightest beginnings latinos rooftop preferable turnovers hels shinji exiting acron mcgu
endlessly farage noel brute olivia trusting hots malaria pounding postponed unequiv rooney cavern conservatism mileage arresting mixer benson authored
proactive incarcerated peaked wielding emmy exqu fret ethn archived countdown tunisia unnatural carnegie nuggets evils introductory mcmahon ambiguity
almighty coloring claus shiva mayer stormed unanswered leve santorum courageous confiscated unconventional moms rohingya orchestra discredit
bureaucrats actiongroup bumps submarines shapiro sketches deceptive rampage muttered pupil fractured revert criterion repercussions flagged blames
inverse makeshift devoid fossils aristotle depleted yuan woes lipid situ furnish samar shameful adversely adept remorse murderous redef prescriptions
poultry harvesting cautioned nikki evaluations harassing bindings hitters adversary setback encrypt cait lows norn bulbs bottled voyager spheres
subtract sensations appalling environmentally publishes diligence advises petrol imagining patrols radiant nuanced lowers ottoman quitting docs
civilized fukushima constructs lans withholding oblivion sanity grocer celsius recounted spoiler logically succeeding polymorph axes leth scor
relaxation deterrent powerless lesbians chords separatists airspace turnaround bombed tion withhold waged comforting iris relocated strategically
gamma lockheed grilled lowe sensing renting geological improperly starving striving harvested playful avenues occupational wakes courier drummer houth
apparel hunted secondly cocktails sizable hurdles fingerprints dispose bosnia inspected fuss ambush manifested suffice compensated cyrus genus
wolverine hikes enrol politely slav rupert eyewitness alto uncomp posterior herz progressively indifference cunningham academia sewer astounding
eldest climbs outcry contag pept melania hubbard romanian chromosome scrambled tremendously craving bundled injuring topping tempest paranoia unicode
egregious oswald gravel simpsons bland guantanamo parity sided pyrrha formulated intrusion carrots moderation characterize teresa socioeconomic perk
paulo trustworthy embodied teasing absorbing unfinished disple professions penguin angrily prevailed cartel islamists halifax retarded itemlevel
retract identifiable buster siri arrivals shortened discrepancy walton kinderg connectors kazakhstan sugars psychedelic digitally braun shimmer shave
astral venezuelan crawling unfolding appropriation conversely keyboards overth viper raleigh totalitarian observes spartan taps roar chars bender
sheldon painter downturn hinder andromeda utilizes ensemble cheers affluent gruesome ubisoft kelley wrench bourgeoisie preston stained chests
groundwater locke dudes decoder paramed medline enqu epstein devastation friendships rubin spurred dossier overlooking iranians fixtures kingston
squash catalogue abnormalities digestive subordinate massac burgers downstairs lasers sikh alexa cyclist buffs raping recommending multicultural
businessmen uneasy dispersed kerala abstraction printers analogous unfolded leveling breached translating antagonist fuzzy bewild signaled protester
garner abducted stalking deserving jorge scratching tease missionary morrow chemotherapy purdue staunch whitney ernest coveted exited nerd vivo
adherence chew coke sergei weary guise concord binge manned illusions billionaires alic coloured nafta macros spac kabul dictated shouts ripping shay
analysed blazers cheered arithmetic tanz witches samantha atlantis pratt spoiled ramirez warlock overhe administrations tint regiment pistols blankets
epist bowls hydraulic ascend santiago unavoid shaman stemming morbid deleting directives iterations milky patented precursor nods ventilation schwarz
ominous lumber spiel isenabled ancestral wrestler iceberg magically diversion robbie kara harms feinstein marrying blending wrink humanoid feld
whistleblower cnbc mdma supplemental powerhouse perenn rodney cubes dante sofa intimidate extradition disabling cardiff memorandum rouhani yates
bladder foreseeable cologne gors sinclair barring slashed humility drilled sewage homepage courtyard vile subsidiaries ammon percept grit fishermen
iraqis distr cooperating melan enlightened salute weakest bulldogs alloy semen williamson entertained penned coupon weakening underestimate shootout
charismatic prudent riches cortical strides drib oilers bangkok euth simplistic impoverished eisenhower augment harden intervened listens rubbish
videot adaptations medically boarded arrogance scrapped oppress junction subdu pett lett regained thugs shelby dictates weiner hale battleground
condol accuses shri motivate reflections sata juicy pric restraining airbnb appropriations slopes manslaughter workings huss frey trench gladly
bullpen groove pretext transmitter underage empires marvin bloss replicated mariners liberated butterfly fermentation offend cessation insurgency
hypotheses plaque jackets huffpost confer lilly adapting shoved refine gunmen izan plethora puberty alma waterproof athleticism capitalize illuminated
pascal irritation astro elvis lich residing stumble adversaries smear arson scant monarchy halftime residue indign shaun lyon lobbyist diminishing
outbreaks goats sandbox malta attrot navigating untrue ludicrous delaying implants journalistic peyton smashing cruiser occupants pint hect mecca stag
brightly uphill lesions bundy biologist giul pertinent unmanned shak endanger replen tailor gadgets audible bombard defiance filipino unaffected
soared bolton compromising brewers vampires dipped xiii sideways habitats bram marina futile epilepsy coping concise tracing sophie crowley adolf
shaky barber uptake predatory intoxicated westbrook baseman sewing agony punt erroneous hannity mould anonymously streamed teased coefficient wartime
fandom downhill interpreting jealousy pleasures chevrolet receptions citrus complied prism realms irrigation bicycles electronically aesthetics dunk
jacques dmit reunited humid youthful entails mosquito coordinating mayhem magnus flowed tackled fashioned reorgan reluctantly vand garland presumption
amenities morals clich welcomes standout dreadful bananas balloons suffix duly geopolitical gemini acquitted scarcity mindfulness styling punishments
numb ascertain rockies perpetrated disarm exponentially abolish foley grease rebirth blossom persists infusion buddies demos acquaintance fascination
overshadow roam speedy disciple assurances natalie mosquitoes numeric independents transitional reactionary mechdragon shortest sequential
breathtaking bates wardrobe berk riverside enriched legalize freaking terrestrial ledge metall southeastern slowdown retreated reins waivers
alteration indefinite stimulating descriptive edmund pneumonia laboratories malfunction homosexuals turbines minded blackhawks feats indispensable
reel diverted likeness subscriptions fingert filthy bernardino perplex sweater steadfast hanson drac commend webpage forcefully relocation satire
sunderland informant bowel purge picnic sapphire objectively obliter loophole journeys omission sidney sprayed guru traitor timet snapping ukip bowed
summarize lender collapses scha antibody disband rover hirosh calam morton euras fences valencia tiff sque quotation troublesome kingdoms nicknamed
appe photographic corpus trog latvia activating licensee disparities freeing jeep silicone hayden suzuki spor correlations tuber ipcc wealthiest
carbuncle fooled knockout duffy insol nordic dancers idiots neville freebsd tart cocoa sampled lookup injections roadway genitals examiner paralysis
reap sloppy herbal incur ideologies backups gret toughness atari revol lawson saunders winc taboo wedge tina infuri anomalies debor comprehension
empowering juices facilitated parsons civilizations libertarians clarks campaigners fahrenheit capcom lace draining liner potency culinary
enlightenment wearer mined incest dvds deval removable miscar vulkan merging carly brisk luxurious bitterness edible rectangle darkest hitch dosage
scaven keller mavericks diarrhea enormously adamant renovation cervical kimber floats witcher swansea salty paula toledo wick homophobic wandered
tightening deserted facilitating emergencies exhaustive heartbeat presume surged dolls chimpan ticks councillor pilgrimage insertion coarse contempor
alchemist trey giov funn ramifications garments humorous pompe nylon lurking sergey mattis misogyny taped grouping beads condu grievances endpoint
scarborough messi psynet rudd shady artemis careless brokers temperament uttered pedd improvised tabl pollut augustine thwart pagan assortment ilcs
unborn randomredditor randomredditorwithno paralyzed eruption intersect stoke noaa lama underestimated mural busted nonex allergy underworld blasio
replacements activates pans longitudinal nuisance swell isles defiant bisc billboard distressed chefs optics redesigned sightings contraction startled
understandably sunglasses surfing shalt unrestricted rename educating grinned velvet swat shuffle saturation vodka foreground vehement turtles katz
menace fellowship drip kyoto nina alarms claud pioneering chiefly ronaldo disneyland evacuate ashe divides berries sushi plurality disadvantaged cling
undeniable haunt quantify differed videog quar bundles alonso neuronal landslide renewables macedonia jerseys bunk buchanan robotics emphasizing
monumental tbsp rotten twisting goodwill immersion brushes expansions marin embarked appalach relegated muster withdrawing microscope crescent
argentine dominic buds widened repayment hindsight brah survives flurry uruguay manageable tariff pistons nigerian strikeouts cosmetics rethink
overcoming distracting stanton tulsa discord emacs reassuring consortium prompts indiscrim timeless pesticide rallying calder chrysler negligible gale
cosby turbine legitimately theodore counterfeit algeria unbeat unres scrambling fallon royalties lester classify unheard controversies enrichment
yankee ecology sark untouched supervisors footh narcotics indices gawker caveat ration resin calibration newport knocks compost sarcast kisses marcel
piet surrounds phillies uncertainties crem upfront reciproc depressive annihil counterterrorism moines manuscripts hypnot prosecutions divert reggie
taxing morales strands pouch nicer intimidated stricter microbial vows quake reinvent relinqu buffett picard chewing localized acquainted fellows
checkpoints reelection mediated hurdle texting trustees dich distinctions usher parasites barbecue grapes assimil haunting firepower defamation
compose allergies strang buoy courtney obsessive braking clinically ramos locale horsepower staffing futuristic damning weeds agile katy carve byron
conducts lick encyclopedia riff boiler hamstring cataly archbishop faux scramble carc cedar sergio grappling deutsche pretended curated headphone
deadlines horizontally summers ordained lastly kendall frig machina waterloo mexicans protector glare recapt inclination imposes haste commuters
extrap tucson slender competitiveness everett cyan extravag elevate watkins excludes sentient epoch alloc slovakia markedly knob adventurers onslaught
hampton cottage hades fragrance petro pend relocate semin rocked articulated islamabad trustee scripting dortmund devon bunker crest arousal sears
polly decode vish refunds wiping puzzled matte tainted symbolism fraz protestors bowser attm sidx cider woven barker dstg sqor istg indulge disgusted
compounded schooling proverb alvarez scarf rectangular hormonal noir marches berm ordinances dusty strawberries perce thur deborah lambert amused
guang cctv mare patriotism outlining blasting ezra undermines clashed transitioning buccaneers plugs hiatus pinball nutr wolfe integers orbits edwin
directx pathfinder reimbursement marcos sockets provisional omaha seizing salts dime faire totaling diagrams yanuk mythical stephens kilograms elbows
prague improv devin supremacists regimen requisite burlington unilateral hires involuntary transpl ascii doubted kaplan falsehood violet airs
fertilizer aquatic hartford evenings sochi profitability macdonald gatherings ascent algebra astronomy containment coronary heartbreaking chero
psychotic equitable ozone cooker reopen rory awaits bolst revered pods amplitude trousers halves kaine cutler splendid preventive dudley admon
inverted hastily hague ledger astronomical circa travellers pane patiently aiding loos consumes bonding tilted menstrual risking riyadh accredited
skirm messing nearing chern beckham swapped goose lofty bamboo elena tightened adolescence rainy vandalism newtown conject cheated moderators deceit
tanzania theolog quirky irvine needy mailbox petra enlarged badass pristine intervening projecting funk chatter examinations leaps subsidized
firsthand coincide fools swollen expended spar keynote unequal progressing gamergate scripted earners larvae paramount camouflage binds shutterstock
mascot colt beyon hairc deus concentrating nipples ponder weddings loneliness mahjong spree caldwell bribery racket champagne modifiers assemblies
sultan ning sulfur orbs lush spectral bushes reinforcement reopened morg auxiliary jquery vertex decon tossing disparate brigham cozy hepatitis
petertodd kosovo magnets edison ceres brilliance derives hypertension lambda flair missionaries rapes defy seismic raphael eurozone scratched lennon
gaia dripping frogs amplified hodg priebus diagnose mald crowned bursting dissolution usefulness persecuted impulses spani zerg spontaneously
inconvenient dismissing plotted eighty thornton sitcom clears sasuke opting enraged runoff giles skewed blanc sakuya hotter crumbling captains
reversing slovenia crocod farrell mercenaries pacing cannons toby badges bernstein initialization biodiversity feudal disclaimer ignition rudy ramadan
adrenaline smelled impunity agendas reborn dustin backer boyle spins pauses shredded strapped scratches attire seminar continual abbrevi frantic
unavoidable artery annotations dors lovecraft unimagin resembled barracks surrogate categorized vaccinated drainage indist whatsapp reconnect emanc
blindness altru infused forestry woody mogul polled flap coax californ hither nailed primal slashing retri departing midway ultrasound behaving tara
stripping orchestrated lends manz oxidative favourable humiliating fidelity xuan layered paycheck vmware servic slump reassure phyl oxidation prized
mistress django encode stupidity yugoslavia qualifies pulses froze urgently mailed cham sustaining puppies antim whispers bravery tame parted indebted
addr eminent ousted reviewer meltdown rearr stumbling batches contraceptive prostitute partname subtly contestants cartridges blush reasoned nightly
semantic disagrees harming embraces strives inland kard heats ginny hars starr skysc collaborators revolutions dismantle confidently kinetic
percentile extracting physicists marshal dashed sioux leigh emin disrupting gland marian dund strand stadiums psychosis brilliantly submerged chow
cages diluted burk archetype spock mckay bere relentlessly crippling arthritis bulg cheryl admirable subtitle originating swore procession refurb
immersed skeptics ceramic weave entrusted barclays novelist ninety disagreements auschwitz backstory cheerful inexperienced witt rapist plateau inquis
cipher shaving murm contractual jaime methodist stewards physiology bumped fructose masquerade promul downfall butcher contemplating modem genders
maternity rocking handguns daca nile tumult vibrations repositories overdue overcrowd legislatures paternal leonardo expressive distractions silenced
biking propriet imposition conglomer yose trolling grac asus specials neph godzilla hegel gloria disemb bane undesirable widening verbally infancy
cutter decriminal dysfunctional besie ernst northeastern marlins segregated maher traverse monastery plent mercer collaborating cummings recorder
flats wrists bakery lancaster endings salam burr barnett precedence rollout boon canter rounding clad unsettling drifting lumia rothschild miliband
juliet recalling unfavorable dances legality inquire messiah eyebrow panicked transformations revolves onward liquids decomp prosecuting yorkers byrne
skydragon nicaragua huckabee amphib blurred visceral collaborated apartheid preset poetic emulator honoring tractor sidewalks violin generalized alec
embargo fastball levine kicker additive escalate tweaked stash sparks essex convict blogging murderers depl jord dissect howe customizable franz atro
outpost glyphosate hastings shove scala amulet exacerbated eater pulp unnecessarily visualize forrest contextual tentative intermittent ridicule
atheism pathogens reintrodu flashlight swearing rotated crane fashionable endorsing ingestion cooks imam teaser converter chimera tyrann sabbath
nichols shelling illuminate dentist whims parchment derog norse unwitting borderline upsetting recourse draped colder pepsi frem veterinary devout
geometric circumference yuri graft disadvantages hubs starcraft galleries korra groceries gorsuch rapists fungi typhoon empress parasite unse surgeons
unethical layouts constants towels deterioration bolivia blinded warden onstage clans antique rhetorical percy rwanda traumat footnote dimensional
intrigue leases apprentices swoop bedrooms incapac yemeni manifestations positives vald mahmoud skulls exodus consolidate clen mummy finer
reinforcements johannes gallagher gymn extortion hippocampus squarely modelling lisp krishna rushes ensued creeping hornets oblivious jeopardy
distinguishing begs parkway sinks hearthstone baton dancer magistrate disturbances romero paraph mischief sharia urinary ejected albuquerque irritated
biol denounce binaries oppos kendrick spew elijah drifted annoyance boxer deceive condolences heals buckets slab stevenson vanderbilt sealing beir
milliseconds sterile phant outp exiled selfie manic resolves millennia explodes constellation adultery broadcasters kindergarten mayweather mute
discreet preschool preempt blocker cumber wrought insurer quotas preached eviction regina seventeen nass folds dotted pizz soils novice neander stool
detonated pikachu abdel subdued tallest precarious unquestion gazette bowman dominates backlog condensed acronym warmed misled ferment karin surrey
stares blacklist expulsion retweet troopers homers contingency brewer undue boise aroused ying morp floral micha gothic ricardo administering
compromises bitten materially dove windshield swapping flawless michele propulsion assigning fabrication barley towering altercation bentley tuna
coolest palp hysteria metatron spawning anarchy shrunk ecstasy etsy applauded sweating redistributed popcorn seminal neuroscience madden dawkins arsen
spiked lyft imperium dropbox favoured encompasses inspires burgeoning yoshi intending filibuster cavs coworkers barbarian auditory muted lavish
hierarchical crippled quiz archaeologists abandonment maneuvers behaviours insure remod spaced affordability fern occupies necklace sedan bravo
abusers anita wasserman merry populace lann repairing psyche modulation decorations apologise garg giveaway flan wyatt authorised torpedo amassed aram
opioids purposely correcting ortiz revoke freeway higgins poking communists unlocking unfit cindy ratified casualty sparkling concerted complying ares
skim hostilities gins muddy mcint conspicuous rescind wearable eclips fallacy solves singers needless selectively clumsy purchaser benefiting yielding
spinach delve crom exporting grop envoy luigi turing facet fluffy excerpts shorth olsen reliant bathing globalization malfoy kissinger orderly
exchanging stout airbus loopholes explor unmarried transformers intellectually darn leftover proofs indexes bonnie conductor behaved synerg catering
lauder yiannopoulos enslaved awakened haku deprecated dystop trembling dreaded garrison unparalleled sensed fencing paso scoff contemplate liga uchij
championed electors hancock unsatisf qualifier gadget deadliest ions accents tweaking shaved chaser methamphetamine normalized guam choked scalp
jaguar semic gould confines codec restrain choking bella slang neurotrans empowerment climbers cthulhu proficient scrimmage wallpaper resurgence antiv
buffers subsystem eradicate blatantly behaves antics revolving bask asynchronous racer nico sermon sizeof entrepreneurial minerva platoon avalanche
conferred patched fractures detects dedicate constituent cosmos sweats sprung unsus bulky philippe fenrir therapists totaled booze diseng motorcycles
inventions lettuce spirituality unlucky tess tongues leans invaders canopy hurricanes bret veggies ejac dino jails fleets mcdonnell snippet chatt
setfontsize electroly gott bras mutants rentals intertw carp contrasts reconnaissance unknow looting regulates optimum cherokee roadside danced
unicorn uncontroll favourites ceremonial vascular contemplated barren whisky devos snapdragon carving undecided advantageous palms starch paddle
flaming horizons probabilities fungus dissenting fabrics soften ineligible estimating lexington shedding nope breathed corinthians attaching analyse
kappa unsustainable interpol protagonists formatted bryce achilles abedin vanish transmitting murky awaited jurassic menacing munitions freem decency
gord unthinkable newsweek presenter plank avalon benz slamming alicia vanity awakens canv blindly ridley serbian alternating sociology attribution
abduction abram sidelined refining oslo pruitt cautiously steph baal comma pall gael misunderstand pesh dismal realistically patio exhausting mazda
streamlined incompetence ethos incentiv gritty exponential correlate consensual conclusive fernandez elong simul kirst protr robo psychologically
conrad oriental presumptive kier harbour coroner flake fraught casing runaway laurent harlem hulu borrower petitioner invoking jenner childish
antioxidant chromebook screenplay adventurous cornerstone rookies originate electrodes scriptures glued discontent afflicted mosa entail preacher
decorative prejudices nottingham rhythms alph danielle strife rematch vetting jinping convened naacp vacancy ruining racks heater randolph recounts
truce casinos carnage stripe proclamation goodies topical specialize amin anchored bearings highland mercenary interviewer somers embryo assy
thunderbolt chuckled earthly dispers gareth pals clandestine cannibal horrend echoing disclosing bribes fresno reese intrusive gripping rasm hebdo
decoding poets jaws meadows harbaugh deletion moonlight sophia usur sanitation partisans sutton touchscreen embryos krug prescribing conformity
plentiful disillusion fanc assassinated perennial stale cached judith shards suarez imran newfound darling wellbeing unmist macos restroom oliv
airways timetable radios cloudy hert unchecked brazen leng diagonal fior stard deficient omnip blender sunrise payout dillon trailed imperialist slur
trenches mirrored immortality contradicts mama carlo canonical perfume uphe reigning caucuses insulted rooting wraith whore tofu rive persuasive
observational salon trunc exquisite mara poop taco homeowner smithsonian loaf yamato clinging immutable fingertips kidd initiating absentee vance
lilith obscured dwarves boko multimedia brewed apex traveler boils spraying starship disapproval shadowy lamented unstoppable cohorts sluggish padres
inscription inhuman jeremiah sharma plumbing timbers coupling sponge idols ticking loader gron stimulated sidebar praises flores migrated lecturer
kettle glyc mandela squeezing ryder commemorate waterfront cout equivalents nietzsche imitation werewolf kirin cunt voic lenovo bonded inhibitors
endeavors havana jolly occurrences impacting duchess summoning bestowed kepler opium reputable ripple burma waive stalls demeanor fluoride longing
grossly showcasing gaddafi conceivable trimmed roadmap saliva trumpet miraculous colonization amput gnome dorothy colombian leased degrading daisy
baptized surname blinked pollen dermat regex nicholson narrower hallucinations firefly attainment nominate avocado meredith reverence euph crates
shortstop propelled oversaw coli nicola overcl aluminium democracies merrill francois traffickers sped prod univ schwe swirling saddened archaic
excessively aerospace ignited handset reforming frustrations deadpool belichick ragnarok drupal hubble saras jonas nostalgic feasibility orbiting
inconsistencies grazing detectors naomi fortified improbable lookout tyres buildup grotesque saber presbyter glaciers shoals kass nicol oneplus
incidental datasets clarkson assembling drinkers qualifiers leash unfounded kickoff reconcil dexterity pioneers precept glossy ieee satirical minotaur
claude carrot diagnoses rendition pathology selects assay dres textual maul interconnected erratic environmentalists phelps engagements economical
gearing favorably mcgill hanged ballpark reyes beware psal inaccessible fray bitterly irrespective endorsements undet merciless immature voucher
blackwell makoto inver yong cathy sarc groundwork amaz huntington bung arbitrarily alberto disqualified hugs spaceship unsuccessfully winged grizzlies
nearer sorceress indigo upbringing separatist racists chained abstinence reinstated symmetry reminders chevy exemplary qualitative savannah rossi paed
dispensaries complimentary beirut cryptographic capitals maximal entropy combatants commuter activision slit chants malone contrasting tidal libel
implanted uproar propositions elven redevelopment measurable imaginable apostles steroid specificity becker marilyn blister carney boasting caleb
woodward tacit retribution dues cameo constitutionally widgets crappy anticipating laurie chats selves satoshi convergence rosenberg nasal fullest
ferocious lobbied soothing gunn inspirational coliseum specializing insanely tarn melanch deployments lessen furry uefa bloodshed meier heirs alters
winchester approximation supermarkets bribe misinterpret thresholds carnival gastrointestinal guideline deceived purportedly ronnie newt spacious
superheroes cynthia thumbnail shirley sheds dams yawn peggy erie juventus caching jian osiris tiffany patton oversized cinderella daesh dogma
freshwater wounding debacle youngster threaded illumination loosen momentarily chun budapest astonished wein revolver delusion relics adherent
handmade combating quadru inhal unab scorn reinforcing adventurer doctoral engulfed lashes asgard distilled pasadena granite smack parachute okin
camel mbps chao forearm timestamp probing grail dormant firstly desmond boobs masturbation chomsky scatter receptive marketers launchers axle moff
gibbs laborers mediation coincided logistical culmination rodents lawfully reperto turrets incess trafford curled preferring privatization irresist
panda mcgr discriminated bartender propensity reinforces eerie hugged filler engraved wrestle imaginative dracula routers spielberg clover pierced
curtains inquisition forecasting complains hermes congen respectfully dalai angus titanic thirds moistur tentacles polaris prairie colossal indoctr
basal mpeg provocation anguish leia initialize predic diploma sociop hammered irma glimps bian stacking fend strawberry cherished inferred socrates
roses foia insensitive painstaking heller alienated acknowledgement vouchers moot cabbage latent meng disperse pandemonium virtuous seams titanium
recollection tamadra rites uterus skillet disenfranch gaal ageing iterator discretionary primates nursery annexation coils everest severus tayyip
skiing timeframe mastermind stroll enix minimizing illegitimate prototyp prematurely manuals cassidy aeros screenings debilitating fades definitively
lafayette stagnant dissatisfaction kidneys ashton cartels foreclosure veterinarian fumble parap strait prick bermuda abound braz sharper ascension
previews communion phony newcomer redistribution lipstick tangled retrospective volunteering unveiling senseless fisheries hinges calculus undefeated
optimizations depress kramer penetrating hawth gerard elias elaine humming condesc egalitarian devs dahl transsexual skyrocket markup heroine
successors buckley downloadable indexed scaff homo racked unob alam siberia satanic resonate welch sparking outl handcuffed serie landmarks reeves
softened dazzling untreated bedford dynamo wrongful lured cortisol hijacked superiors rowling guinness unearthed centrif shameless icing predictor
agitated repr knitting lima fodder breakup appalled antidepressants sussex doorstep shank misfortune bona degraded ness aversion supplemented deprive
sparkle saban mandarin maharashtra mirage fragmented believable gladiator convertible bourbon powdered smoker manson goodell obedient bothering
foregoing anarchism littered schiff anecdotal fian behavioural sublime fruition corrosion likened besieged linemen vitality shortfall pronunciation
insightful chou charms bins ambassadors saturdays inhibitor conor xperia protestants soaking mandal phased scams buzzing italians lorenzo hesitated
cliffs interruption underscores autob watering pastry visionary templar piston antid pard waging nobility injecting retake wrestlers partnering noses
bouts constantin moratorium penchant offensively proxies taiwanese verbs oman persuasion multit scissors apocalyptic absurdity playbook autobiography
sneaking rightfully niece greenwald linen pollutants pcie kraft terminator silhouette grooming isabel morsi valves pharma penetrated rodham protoss
overest exasper trickle wretched microscopic checklist adorned increments cosponsors masse sinn hordes natasha arranging glean discredited clinicians
achieves emerson principally frail thanking recl suppressing antidepressant lisbon pearce plung divest resurrected rosenstein necessities carniv elys
barney milestones dismantling reprim crossings patriarchy blasphemy sabha colo medina hannibal thence synagogue essentials wink icelandic hayward peac
malice flashback layoffs trooper hinge bauer audits unsuspecting broch apprehended malk codex deng disrespectful ascending alibaba dempsey throughput
quarrel hemor irritating redeemed horny standby sleepy extrater compliments installs banging metaphysical mccorm mikhail enthusiastically gripped
comedic guerrilla decoration consultations unamb plagiar magician erection telescopes unprotected stocked wastewater intimately icloud constable spoof
nefarious fins censor esper intersections lauded physi generously thenitrome thenitromefan arisen glands pavilion gupta uniformly ramps vanessa routed
limp vaping experimented olympus amon sighting infiltrate signings meow elapsed bulgarian spills plymouth domestically watergate synchronization
genomes locating kitten rinse grapple leasing mislead perfected nudity nonpartisan nuances deductible samp galvan nobles eaves risked neurot underpin
loft subcommittee mongol manifests gaga synergy religiously gerry choi hemorrh tendon injure fiona agitation esteem dodging ceases intakes inserts
embold furnace coyotes brach handshake bruises grammy scandinavian kardash effortlessly groin roofs estates haha densely plastics incidentally chanted
forceful bieber kahn hideous verd syndicate fundamentalist truthful jing downed enchanted mcmaster hare params allowances turbulent complexities gigs
patriarchal calc guan pathological underrated fluorescent quan fidel vehemently papa internship flakes reusable polluted peng circuitry madonna
planner frantically faithfully andersen sora abnorm disobedience shea skirts sawyer worsening scapego trove nguyen illuminati tracts organise ostr
leveraging daredevil extermin romo contended encountering sweets cohesive repud lizard pilgrims ruff salesman ankles patty discrepancies unconditional
osaka secretion depletion mous himal fleming cytok hick batters quentin coaster portraying wielded proponent graphene flyer recurrent waterfall
tampering abel hendricks lucius stump occupancy finder nunes wellness negatives thiel blight repertoire quer hapl thames mysteriously perish engels
restless dinners trout seym tragedies didnt ailments observable dusk professionalism prescott indies mehran endemic pedals correlates sponsoring
damian axel nonviolent homophobia biomass srfn mongo cerberus slay nonexistent clarence blackburn portals rita levant tricked horrendous aman toad
peeled manoeuv uzbek hector resumes accountant adversity hampered larson doping bearded watershed choir sculptures sneakers confronts elixir recal
grayson hairst humiliated polio complexes babe yells princes bullies pleasantly denote unpublished kneeling lapse referees puzzling prometheus pharaoh
facilitates jewels booklet polarization moran wonderland grep vortex largedownload publicized festivities mane fleeting chromosomes busiest beaver
repealing metre dirk goggles drawbacks complainant authorizing antitrust exaggeration seraph haze extinguished bosh vents scrape microbiota stev
suggestive decipher kejriwal greenpeace declass sounders decrypt brushing janeiro geoffrey hazel viewpoints crispy solder cassette identifiers smir
grieving boldly esche swirl negligent stephenson zoro localization seymour anglic paige omit rousse invitations childcare lull sanford usability
diffuse sprites vegeta smugglers reformed lois unfl tomas rumble testers bracelet paramedics skinner flask overpower lodging absorbs helena pamphlet
hiroshima holistic detachment aspire complicit greenwood respawn abhor mockery consec toro funky detriment degrade retard fragmentation cowboy sieg
strauss optionally executes acidic jasper plunder dane gina canine socialists impetus supplementary kinnikuman organisers documentaries resorts
bragging hectares toxin faiths ardent okawaru tidy instinctively bray feral perverse warped nineteen cabinets srfattach sloan powering stren cafeteria
grimoire raining circling linebackers repatri camden lyric descriptor valleys backstage servings overseen asteroids springer mens multim firefighter
chlorine sparing polygamy pell flashy madame prefrontal prerequisite misconception harshly giuliani tubing rightful specialization passionately latch
helium dipping interpersonal subter biologists optic denim corm fearless alot clifford neuron grading roaring caucasian monog appellate liaison
spherical perished blot benches pioneered hurled yosemite reefs elector uninstall impede blinking goto stabilization yanukovych outlawed ventura
plantation yacht huawei solvent gracious curiously capacitor invocation prenatal deteriorating normandy ambro setbacks scourge msec pricey overarching
bale worldly scenic disliked artisan infield unresolved moreno sailor rife tropes snatched obnoxious unexplained walters gull aerobic cramped honolulu
susceptibility shiv limbaugh muss britons secession jpmorgan councillors liang nervously attractiveness stains overwhelm trapping fide pamela
servicing overflowing erit chuckle queues anchors awoke divergence skew divul forks promoters levied pigment cylinders snatch perpetually licking
kraken holden clsid projector denotes folly zurich nurture coastline frivol phylogen hauled wiley jessie treasurer colonists inund mister resultant
adjective laurel hindi membranes forwarding collided carolyn solidgoldmagikarp stressing archie klopp footwear scree anthology fluent bondage boll
unrecogn undergrad forgiving glover responsibly mobilize effected kale infringing fitt exoner pelvic automate kear boredom regenerate comedians
suspense neocons shinzo shielding gaul paramilitary multif tanner goddamn befriend insin harb facade powerpoint bluff favoring fema evolves este
canterbury starfleet drawback norwich transformative propagation denise bett stigmat holster ordinarily adhesive gathers induces interchangeable
trance incorporation awkwardly sturgeon subjug fanatic irreversible lifestyles feds congratulate indistinguishable commandments overe lobster samoa
kitt stuffing warehouses fiji pellets takeaway landfall settles fared daly tarant fuji glitches enchantment calculates leapt hypothesized gustav
undercut lyons dhcp retirees insidious finalists aure accuser wastes lori constituencies supper misplaced managerial exce preserves tsarnaev tripled
hanna approves lutheran robberies gravy unveil hutchinson tsukuyomi fugitive accrued chicks stopp blockers commenters mayoral antennas revamped
entrances tenets donkey animate inconsistency pacs actu hsbc payoff deities censored clojure confounding reckon spotting signifies propel festive
pledging berman rebellious overshadowed infiltrated scalable newfoundland meadow partitions hairy perpetuate nutshell hobbit curses quieter fueling
capsules childbirth malls inept spectator culminating siren sprang chung pian feces banished heinous amir notebooks foundational marvelous withdrawals
dhabi contagious pronouns morphine kosher fused aether tabloid repro berserker dramas pastors acrylic majorities fielding alchemy romeo lavrov
impractical playboy swaps theo illustrating dismantled guth triumphant encompass bookmark predicate whence nonprofits diabetic heartfelt interacts
bombardment lowry blooming molten toured coefficients trayvon populous tinder contestant morse grassley clicker expr sincerity elicit tacos postwar
insofar midterm sammy fisa alexandra signify obfusc aggro renault goofy briefings derogatory forging koran bucs palate siph marginally flirt
goaltender forbids clerks robbins premiered magnification rouse preclude pulitzer kodi lena refinery endowed counselors dolphin mith armoured sharif
frazier jams bandits presbyterian seminars issuer chaired marrow primordial limitless undrafted cohesion necks footballer detectable unde shone
budding kemp thwarted ingenious fostering ingram accelerator sunscreen tuberculosis spectre substitutes inco afgh diligently afar fireplace omni shib
headsets diffusion darkened sleeps setups parsed mammoth fitzpatrick emil benny hearty conson plummeted pests referrals lionel underdog slater amar
timid piety surging desks spokane anfield warships cobra arming mckenzie ferdinand boone caravan dill bundesliga healer negate critiques outsourcing
upbeat hangar cruising niagara subtitles squared bookstore revolutionaries carlton despise carts honorary triangles reprinted graceful mongolia
disruptions drains consulate bends fulton renal inaction photons bruised nests libre daryl freezes cumbers starg legions handwriting grun moth motel
bild prope vera barth lashed zamb staples corker continuum deems repressive baffled crave entrepreneurship directorate vines ascended dogged
unimaginable relativity assassins dissatisfied conduit rican scares protracted kristen scrib twenties predicament handcuffs fruitful ludwig attest
breaker biologically renovations henri unilaterally sidd cumbersome javier trendy rotting scraps facets veronica sana radial wildfire cato waitress
chops bluntly patrolling scathing deteriorated depictions authenticated promulg rehabilit glacier vomit fermented khalid graded magicka ichigo shrew
legalizing allotted archdemon oily inducing amygdala admins schematic moan cameroon tink butterflies goff workspace corona cantor padded zheng
estranged dunham smokes entitle centerpiece thereto arcs obligatory sven albania hardships autos apes intoxication yelp briggs spawns wiggins
showcased resorted whipping imitate digestion usps regretted broccoli postings accumulating mayors anecdotes botched constantine devise pudding evoke
detox mccartney metast krypt tending varg foliage mentors aires minimalist ingested trojan qian eroded blurry buffet fnatic crusher ventured aero
thinly arra jacqu theorem smartest kron decap adjunct redacted prehistoric explanatory uttar manny universes sensit kung paced recomb faul pooled
bulldo michaels wrecked portrays guesses lapd consequential transgress oaks trivia grasping practicable hoop unintentionally ignite colourful ellie
manpower emoji sophistication underscore practise blob automobiles parting lank remembrance eased covari sind dissemination moose clapper invis
worsened legislator rowe dealership investigates cascade bidder presiding ding contradicted shuts sinful charisma totality restitution optimus
clueless nutrit landowners flushed broaden println proto wikimedia palo storylines evangelicals darrell rotor begg blumenthal weaving downwards
esoteric furiously foreigner hound calming upscale colossus chloride brookings underside vape memos stabilized techno anew collegiate pyro frontline
ammonia recep byrd appellant olds slurs buckle alienation aberdeen overriding despised hallmark stemmed principals cheesy settextcolor cohn fridays
clipping berth presided vets cloves mccull illiter resistor suffolk denouncing ryzen souven caregivers scarlett trough taxis tabletop hitherto
disinformation complicate palpable ausp showcases retrieval refute inquired negativity conserve afterlife presupp gillespie perpend spilling hypers
klux flattened kund inscribed facult unprepared satisfies pulmonary infiltration externally congratulations airliner flung snippets recursive
mastering overtly encro lancet abyssal squid narration naughty spartans shatter tacoma purposefully gerr itiner glock shielded redirected kham labou
diapers cellar berks undone millionaire cords sequels lewd dmitry slaying complication erica intermediary consolation siem fixme culminated conduc
positional greets thinker ingenuity freshmen fedex dwindling sten neighbourhoods classmate leftists climates scythe hopped doomsday gasped moniker
uncanny transports labrador railways appliance confederacy unbearable dorsal hypocritical georgian ambrose loch gubernatorial xeon avenger juxtap
chopping finch gohan lightsaber herpes deserts situational textile cornwall contraceptives bihar analogue takeoff majestic commuting gorilla alas
acquaintances spiritually eyed ender translucent nighttime kamp mata hors kins reeling clutter avert cheong pryor usaf garry exposition stockpile
clothed treacherous frying restraints embodies negotiators appalachian jenna passers shorten innumerable armory suitcase wasteful mccabe indecent
residences selfies barkley cultivating ballard nascent irresistible awfully equate anthropology sylvia intestine innocuous metroid appraisal freddy
docking jonah asbestos collagen hybrids invoice inequalities lucid witty bruising licences mcgee jammed distinguishes yamaha hume beetle booths
feldman excavation philosophies unforgettable verifying subordinates gabe dumps poignant heidi mages liberate circumcised mermaid matth wichita
storefront adin explorers pineapple amalg ovarian haircut chilled styled ministerial sulph bohem educator eleanor heaviest grasped crooked
predetermined maniac breaths lauderdale hobbies leaping kittens suzanne halting swallowing eighteenth particulars benevolent rundown valerie
civilisation schn peanuts flavored roared cutoff ornament architectures wilde provoking rationality justifies dispel envis doodle xiang detractors
conducive transmissions alluded dope goldstein wavelengths attentive accol crawled flourished olivier widen misconceptions venerable klingon payday
veiled everlasting cree hating grinning geographically weeping impecc bloated fein persever pitfalls predominant farmland qiao bahamas inflicting
homebrew undertook curly harding tempered harrowing frankenstein predictably backfield genomic boutique batted afloat olympia endif winters scattering
airflow byzantine betsy optimizing ecstatic clout subscribed rehearsal amps shang sprinkle assailant coinbase retina nuns bikini restores ashore
approvals cortana signalling rebuke flares downtime stagnation grunt assures intraven manziel slams cultured creditor chattanooga cloaked stella
cheaply galileo suites deliberations wynne akron honoured edged ezek migrating shorthand crotch calves frie strikers repentance arteries cryptography
sabres intertwined docks allele opacity nipple handwritten chamberlain laos trillions descendant ceilings nont miscarriage rigs ministries elaborated
delusional blackout subdiv linkage chronological resettlement pastoral fritz bellig semblance curtail clinch pursuits flips coupons cloning quartz
spears pious depreciation pinnacle seeker unfolds marse extravagant speedway craigslist upholding bloodstream limbo wildcats markus exhibiting
habitual delinquent burner contemporaries gimmick nozzle staten invincible burnett pebble marino wasteland rite panasonic middles horton curing
adjourn fearsome propell conflicted insurgent coales southwestern dissu boxed brune gardening engel purified placeholder eliot caul cadillac adjusts
friedrich blizz mammal maurit damien stereotypical attic cyborg awarding papua xander somerset catchy certify tides curator gmos carmen wipes
summarizes whistleblowers crochet repet karachi igor keane retreating dickens arenas curv chores elise mammalian sanskrit learners glamorous furthe
narrated disorderly roku understatement saur rodrigo asap rejoice electrode worshipped popup deft buenos bangalore kenobi normative goblins cafes
unclassified sclerosis sonny widest looms justifying granger flourishing rave cooke arte miscellaneous clancy valiant succinct quickest spitting
snowball predis baxter chaff outage nesting notoriety fatig hugging bothers panzer chandra volts feeble hess manufactures subsections krugman alps
sequest ultron tinker mismatch morphology sixers fortnight tanker plush attendants greenwich vacated uptick meridian renovated kubrick lousy izzy ajax
adapters petraeus affirmation stor constantinople ponies lighthouse adherents brees plaster dearly shaming subreddits pigeon pessimistic apologised
gloomy lyme tome deepen theorist highlands interfered formulate vaccinations banter outfielder narrowing proclaiming posit registrar pilgrim prett
lifeless orcs kindred millennial persia granddaughter brooke pickups wilkinson expel kislyak jargon polarized rebutt apprehension kessler loll ghetto
oscars reimb aggregation airstrike deflation herrera advisable workaround typo alum jamal captives lieberman alcoholism recite gaping baskets
corrective filament deepening buggy tenancy mubarak tuple droid forfeit rasmussen kimmel meticulously apopt mindless digs ebook blinding kelvin dover
antioch collide sleeper jarvis antiquity adinida abuser assorted gideon bustling rahman waiter presets reptiles garr chak hashes failings folklore
cena macarthur periphery reckoned reservoirs dives vividly bellev eclectic asuka bystanders goodwin criminally nanop weir parentheses outnumbered
counterproductive tobias synaptic hiber debunked exalted pixie thrott britann madagascar billboards rpgs doesnt greenberg sling emptied pixar dharma
endot babys ridden beetles illuminating fictitious molded xiaomi delim organising hoops fuckin decad unbiased smuggled kios inquisitor snowy scraping
burgess cassandra pasture scotch hysterical browne mobilization spearheaded embroiled conjecture paperback recovers shogun pediatrics sweeps
headlights concoct unmarked richness dissertation seasoning catholicism disembark nero townsend mesmer fireball frenchman augusta sled reused gunshots
barbie cannabinoids kinder rejuven rupture breaching paleo ames aborted felon causation prepaid pitted shelley russo willfully canaver arpaio fateful
spirited hegemony boycot enrique timelines sahara quincy costco motivating chong pedigree tasmania prelude chau spiegel philips kafka upheaval
sentimental akira electing commenter nebula nadu enshr clyde signage deline phosphate vall bethlehem tantal autoimmune defences tranquil ploy flavours
weston volvo microphones headlined primed hoard shad triangular capit ancients lash convol pubs assigns bowen contaminants robbers hotline guardiola
kaufman dresden alpine sard unequivocally sweeney pancakes oats sourcing sizing moderates chocobo exhilar snug despicable sarcastic latex tamp
reverend chinatown gaba canaan governs endeavour worsen scanners deviations compton endogenous emulation bould borderlands restricts mosaic melodies
disson broom nerds mete crept girlfriends ushered insomnia gestation clockwork bakr thirsty faculties nuance darius preferential starve gong
unaccompanied commando vaughn hopping caveats robbing mitigating aptly tyrant midday gilmore decker phenotype plex chic residues confederation
perpendicular synchronized refreshed adore pies unwelcome kenyan pats aliases garfield campaigner advancements okinawa starved sizeable mrna
suspensions teaspoons coercive masonic latt braces kats celest coulter wilmington vending yellowstone shampoo superhuman ridiculed holiest interns
hone paragu dangling revocation outings inaccur outlandish anus unregulated succumbed cuff substr coffers automakers daytona jarring fumes disbanded
strikingly spores lyndon orally tumultuous displeasure cones appease tripoli aless poked originals proverbial postpone misty staffed diligent ponds
mmol clenched corsair caricature schro cellul texted retracted upkeep workplaces amplify multic convoluted snail saline insurrection petr navajo
rudimentary laksh transformer goddard coincides shotguns proletarian slander embell apologizing mulcair gibraltar allot whine issa faust barron
victimized nurturing flavorful directional clasp surges canoe premiership defied tripod gasp entangled zeit rusty havens vaughan stricken delusions
gratification enticing oled totem gators impedance cary dred concurrently superpower dickinson pree rollins denomination lana inciting suspending
mountainous luthor schwarzenegger muller devi longh refinement waterways diner initials paranormal swanson esther irrad buckingham refill
differentiated chirop atkins excise cabal howell resize budgetary stras apiece precincts skyline devonline deform counteract lange nodding populism
counselling undeniably railing horowitz simone bungie sweaty banquet inventive astronomer stamford rusher centrist subclass disav defund nanto pacif
numbering laughable meticulous congratulated birch swayed semifinals humankind voicing thug pornographic moaning grievance confessions relegation
riddled lowell hyder salads industrialized hussain chennai appointing cullen pores biochemical cowardly helsinki ethiopian biotech intensify
instantaneous paving landfill dads incendiary livingston hilbert clive chimpanzees aadhaar achievable intangible ballet bailed turbulence occupant
statically onlook dehydration acquies upton incomprehensible backdoor rhino maths heresy roche lydia pancreat solicitation circadian foray cryptic
homs quarry jericho resists snapshots bestselling antic sutherland parm immobil nifty fentanyl darts sheridan stances sorcery perjury nikola fiance
jordanian humanities tanaka consultancy remission confid improvis unwillingness portfolios claimants indemn evaluates bedrock oprah manipulative
willful relapse extant poppy knack insulated untold converge refuel distortions ravaged mechanically reilly becky rake melancholy illustrious
dartmouth razer pageant wiser chemist plutonium tirelessly infertility trident showtime uncontrolled innovate tosh swast rink cardio vantage vans
propagate methodological triglycer ingrained decisively boosters desserts testifying scully lockdown scher whitman ramsay hikers hyundai conscientious
clerics siberian relayed welding shal samson tumble subcontract shinra terminating leakage midlands caucasus albion registrations comrade clipboard
discouraging oops empath donn bayer footprints chilean clubhouse magnum encamp watered calais complexion sects renters infographic locality flora
populate subsistence auctions mcauliffe manifold calibrated caliphate condone piling embody crimean vying principled quirks frieza crib herod timers
macintosh glide smelling unsu condos bicycl juggling kardashian balkans nutritious integrates adjoining whiff bilingual touting infall nikol regulars
pseudonym exhibitions reverber reciprocal itching phar emitting birthplace taunt luffy amit circled deforestation overtake lucia accompanies reassured
sporadic medial cannabinoid barbaric epis unsolved acknowledgment kitchens pegasus photon clair diaper jeanne pelicans instructional discriminating
tran cornel tyre aspiration bridgewater coco detach physique complicity interrupts utilitarian spaghetti porous esteemed inciner espresso
mathematician overheard quizz flattering attaches trinidad foothold uncharted julio centauri clutching gutierrez teleportation reversible liberating
asphalt wildfires technologically emits irregularities cherish stink rost coughing mccann renegoti inquest swordsman exerted perilous obscurity
assassinate rescuing harrington bord afghans augustus viewership additives maximizing rove louie streaks tert colonialism burying dprk worrisome
vocational sails correctional familial episcopal vetted crammed percussion oranges roundup zionism unintentional glutamate mckenna leaflets
functionally caloric shenan repaid bashing collaborations unaccount teamwork piping minced diam mascara sucker peck perv nish aromatic asic quadro
lockout seeded snag grounding reliever frivolous microbiome schl ples bleach irwin eaton multiplication coerced exorc staggered inertia classy
transporter matured hijab biome extermination tues takeru audrey aden narcissistic baird connie whispering hatt disinfect deducted partake downgrade
democratically limestone exempted fledgling virginity frankie restrooms objectionable rahul postage communicates addon slumped jpeg icar wolfgang
unconsciously sass flowering draper manure disingen inhibited headquartered enigmatic redress rattled diction fascists coasts petersen bezos mistrust
grate vowel unmatched bordering contiguous distraught anatomical resusc abiding vacancies hypothal werner witchcraft acupuncture jinn jarrett pyth
juveniles heroism doubtless bitters compulsion kathryn millionaires intrinsically bolstered tutor rudolph kimberly indignation fracturing vacations
booted soar glances creatively solicitor superflu bombshell brokerage raiding angled haitian unwittingly tallied biomedical euphem brainstorm modesty
ipads ezekiel powerfully fisherman meshes etched toppled valhalla recomp derailed dehuman brittany exclaim pegged astroph rigging fixation catapult
bolshevik loudspe almonds unbeaten rosters ellipt harriet commodore melts ratification multiplying interoper ascert scorpion portsmouth quarantine
slideshow centimeters synopsis spate nominating melvin throb generational unlawfully eyeing brunt interstellar clitor croatian eucl mutated disapprove
squats levers transact kinect kuala shattering arsenic angelo analges tactile prophes diced incrim dips crucifix shanahan simulac recycle bombay plaus
mace intruder sneaky emancipation playthrough gauntlet unbelievably stitching shenanigans vitri individuality barking slapping disgruntled angola
thurs captcha angst adidas joyful whining phosphorus attrition timberwolves zipper relat cropped raged lumpur guerrero offsets mortals dismissive
throats chipset chilly stoked fiasco inoc fiorina leukemia eluc announcer lithuan armageddon pepp atkinson vanishing redundancy prophetic habitable
faintly flanked spurious shading motivational santana excruciating miko leopard baths demoral unification priceless gelatin emanating allaah outburst
eras lazarus rebate creeps kira amos corvette pesky challengers ukrainians forsaken entrants embattled defunct poisons traveller kern ransomware
amtrak cradle antioxidants nasl salient allocations mashed pounded fanbase casc analytic summoner vanquished crabs transistor koen annexed faked
hindered inappropriately trespass paws negotiator christensen dianne elegance vigilance castles holo emphatically titus richie animosity uriel
psychiatrists abby incite weasley farn maize interacted transitioned parasitic harmonic decaying baseless transpired abundantly treadmill sshd
frontman jakarta midrange perched overboard carth deterrence sill sinners opec unworthy strengthens slicing malnutrition filmmaking polk wetlands
allowable steered sicily mustache mids clipped circulate brittle wealthier overwrite overpowered gerrard acutely moroccan vigilante bagg resided
remnant emptiness outpatient leptin payton gleaming polo mormonism creatine anon hatched xcom asheville mango orthodoxy unesco topple adoptive sagan
glou helpers chronically huma accommodating wrinkles dodged precon compressor kare evict warwick modernization bandwagon refuted netted naples genie
fielded dere parables nihil happiest floppy unison redmond fuelled eminem secretaries canaveral pomp detainee plantations towed sheltered etiquette
juno grimes soluble intolerable uninterrupted tooltip interrogated gunned tether crumble clustered hasan dystopian joystick thib overcame minimized
brenda torches rapport kcal curls bearer cynicism abras debugger debtor kers exacerbate stacy branching salsa mishand konami anecdote agreeable
nathaniel heisman inhibits hashing solidly aspirin streetcar judd flashbacks unhcr curfew calmed participates nonsensical fullback metabolites looted
vetoed stiffness lowly unforeseen anesthesia reconstructed inexplicable hardness acer woodland metaphors wembley pavel rewriting perceptual
unsurprisingly tagging litres bounces overdoses sheila scion bolted dmca uniqueness epigen reckoning senegal pharmacies geral rabid weep behest jace
whirlwind utopian kidnap livestream subversive assailants sprinkled laced itch ported logger embryonic delegated centrally hereditary marriott
prohibitions entityitem unrem laureate denominations klaus insur fielder sparrow mondays lerner patronage contrasted mania condemns ange composing
pepe paddock heterogeneity ideologically fishes cursing rutherford amelia stunts bead stocking hump nieto gopro parcels actresses striped mellon
neutron flavoring responsiveness jindal hitchcock webcam twain namesake unorthodox funer plos fiesta enclave homegrown conceptions reiterate meager
installments photoc cabrera rosenthal lansing invests ufos tragically concedes schr melanie visitation idiosyncr fractions foreskin poaching
stimulates gork nemesis indra inspecting grandma whedon shant purg partying testimonies pressuring hereafter dissidents solitude lobe indis credential
nirvana berkshire wills judah embassies bottleneck bount typew alvin brim passively bounded criminality biomark dispatcher ultraviolet tata chemically
formulations annihilation argon morphed conquering thefts frontrunner royale shockingly composure motorsport grids monteneg strutconnector massacres
briefs flared claimant cures giveaways cringe aristocracy ulster glared wilhelm radiator ghostbusters herds countering charred warheads iodine macy
departures dyed quotations gist christy antigen paternity ardu anchorage overloaded tammy waning rodent worcester dwellings bullish retaliate migraine
chevron marquee haas gddr willpower impossibility franks cleaners sorely flickering dunno dysph mainline wally bigfoot retrieving duplication
relational quaint biscuits shudder antidote sauces reinvest dispensary insepar toddlers gpio lackluster aback toolbar oust contemplation guaranteeing
heist cannes collaborator mobilized brood refin warranties babel swath caches antagonists hotly conspiring sheen jesuit giovanni buttocks volleyball
shrouded scoreboard asses deregulation telegram canary kernels duff leica garmin orphans claudia calendars leilan brunch hawking sensibilities kand
reclaimed rappers gazing snipers reverted conglomerate harsher desolate hitman amplification regress collider informants gazed
""".split()
